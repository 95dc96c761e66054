"""Code tables and the column expressions that apply them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these texts, codes and their order.
GRADE_RULES = [
    ("障害", 0), ("G1", 10), ("G2", 9), ("G3", 8), ("(L)", 7), ("オープン", 7), ("OP", 7), ("3勝", 6),
    ("1600", 6), ("2勝", 5), ("1000", 5), ("1勝", 4), ("500", 4), ("新馬", 3), ("未勝利", 1),
]
CLASS_LABEL_RULES = [
    (("500万", "1勝", "１勝"), "1勝"),
    (("1000万", "2勝", "２勝"), "2勝"),
    (("1600万", "3勝", "３勝"), "3勝"),
    (("オープン",), "オープン"),
    (("未勝利",), "未勝利"),
    (("新馬",), "新馬"),
]
UNKNOWN_CLASS = "不明"
TRAINING_CODES = {
    "gender": {"牡": 0, "牝": 1, "セ": 2},
    "turf_or_dirt": {"芝": 0, "ダ": 1, "障": 2},
    "lap": {"右": 0, "左": 1, "芝": 2, "直": 2},
    "racecourse": {"良": 0, "稍": 1, "重": 2, "不": 3},
    "weather": {"晴": 0, "曇": 1, "小": 2, "雨": 3, "雪": 4},
}
SCORING_CODES = {
    "stable": {"栗東": 0, "美浦": 1, "地方": 2, "海外": 3, "不明": 4},
    "class": {"新馬": 0, "未勝利": 0, "1勝": 1, "2勝": 2, "3勝": 3, "オープン": 4},
    "sex": {"牡": 0, "牝": 1, "セ": 2},
    "ground_state": {"良": 0, "稍": 1, "重": 2, "不": 3},
    "race_type": {"芝": 0, "ダート": 1},
    "weather": {"晴": 0, "曇": 1, "小雨": 2, "雨": 3, "小雪": 4, "雪": 5},
    "course_type": {"右": 0, "左": 1, "直線": 2},
    "gallop_grade": {"A": 0, "B": 1, "C": 2, "D": 3},
}
CATEGORIES = {
    "weather": ["曇", "晴", "雨", "小雨", "小雪", "雪"],
    "ground_state": ["良", "重", "稍", "不"],
    "course_type": ["右", "左", "直線"],
    "race_type": ["芝", "ダート"],
}
COURSES = {
    1: "札幌", 2: "函館", 3: "福島", 4: "新潟", 5: "東京", 6: "中山", 7: "中京", 8: "京都", 9: "阪神", 10: "小倉",
}
DISTANCE_BUCKETS = [(1301, "S"), (1900, "M"), (2101, "I"), (2701, "L")]
LONGEST_BUCKET = "E"
GROUND_STATES = ["良", "稍重", "重", "不良", "稍", "不"]
HEADER_WEATHER = ["曇", "晴", "雨", "小雨", "小雪", "雪"]
SURFACE_RULES = [("芝", "芝"), ("ダ", "ダート"), ("障", "障害")]
DIRECTION_RULES = [("右", "右"), ("左", "左"), ("直線", "直線")]


def first_rule(text: Column, rules: Sequence[tuple[str | Sequence[str], object]], default: object) -> Column:
    """Value of the first rule one of whose keys occurs in ``text``; null text stays null."""
    result = F.when(text.isNull(), F.lit(None))
    for keys, value in rules:
        keys = [keys] if isinstance(keys, str) else keys
        hit = text.contains(keys[0])
        for key in keys[1:]:
            hit = hit | text.contains(key)
        result = result.when(hit, F.lit(value))
    return result.otherwise(F.lit(default))


def grade(text: Column) -> Column:
    """Class text to grade number, 0 where nothing is recognised."""
    return first_rule(text, GRADE_RULES, 0)


def class_label(text: Column) -> Column:
    """Class text to class label with half-width digits."""
    return first_rule(text, CLASS_LABEL_RULES, UNKNOWN_CLASS)


def code(text: Column, mapping: Mapping[str, int]) -> Column:
    """Code of a text; null for texts outside the map."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.element_at(F.create_map(*pairs), text)


def fixed_category(text: Column, allowed: Iterable[str]) -> Column:
    return F.when(text.isin(*allowed), text)


def distance_bucket(metres: Column) -> Column:
    result = F.when(metres.isNull(), F.lit(None))
    for limit, name in DISTANCE_BUCKETS:
        result = result.when(metres < limit, F.lit(name))
    return result.otherwise(F.lit(LONGEST_BUCKET))
