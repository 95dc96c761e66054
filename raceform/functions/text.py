"""Parsers of race text. Bad text gives null (or the stated default), never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the race pages.
RUN_TIME = r"^(?:(\d+):)?(\d+)\.(\d)$"
BODY_WEIGHT = r"^(\d+)\(([+-]?\d+)?"
REST_WEEKS = r"中(\d+)週|連闘"
DATE_FORMATS = ["yyyy年M月d日", "yyyy/M/d"]


def null_if_text(c: Column, *sentinels: str) -> Column:
    """Null where the text is one of the sentinels."""
    return F.when(~c.isin(*sentinels), c)


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def run_seconds(c: Column) -> Column:
    """``m:ss.f`` to seconds; a time without minutes counts as zero minutes."""
    minutes = F.coalesce(to_double(F.regexp_extract(c, RUN_TIME, 1)), F.lit(0.0))
    seconds = to_double(F.regexp_extract(c, RUN_TIME, 2))
    tenths = to_double(F.regexp_extract(c, RUN_TIME, 3))
    return minutes * 60 + seconds + tenths / 10


def corners(c: Column) -> Column:
    """All positions in a pass-order text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def pass_order_mean(c: Column) -> Column:
    return row_mean(F.transform(F.split(c, "-"), lambda x: x.try_cast("double")))


def row_mean(values: Column) -> Column:
    """Mean of the non-null items of an array; null when there are none."""
    kept = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(kept))


def first_corner(c: Column) -> Column:
    return F.try_element_at(corners(c), F.lit(1))


def final_corner(c: Column) -> Column:
    return F.try_element_at(corners(c), F.lit(-1))


def race_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_date(c, fmt) for fmt in DATE_FORMATS])


def sex(c: Column) -> Column:
    return F.substring(c, 1, 1)


def age(c: Column) -> Column:
    return F.substr(c, F.lit(2)).try_cast("int")


def body_weight(c: Column, on_bad: str = "zero") -> Column:
    """Weight from ``468(+4)``. ``on_bad='null'`` keeps unreadable text out of means."""
    return _weight_part(c, 1, on_bad)


def body_weight_change(c: Column, on_bad: str = "zero") -> Column:
    """Change from ``468(+4)``; a readable weight with an unreadable change has change 0."""
    part = _weight_part(c, 2, on_bad)
    return F.when(_weight_part(c, 1, "null").isNotNull(), F.coalesce(part, F.lit(0))).otherwise(part)


def _weight_part(c: Column, group: int, on_bad: str) -> Column:
    part = F.regexp_extract(c, BODY_WEIGHT, group).try_cast("int")
    return F.coalesce(part, F.lit(0)) if on_bad == "zero" else part


def rest_weeks(c: Column) -> Column:
    """Weeks since the last start from ``中3週`` (3) or ``連闘`` (1); 0 if neither occurs."""
    token = F.regexp_extract(c, REST_WEEKS, 0)
    return (
        F.when(c.isNull() | (token == ""), 0)
        .when(token == "連闘", 1)
        .otherwise(F.regexp_extract(c, REST_WEEKS, 1).try_cast("int"))
    )


def link_id(href: Column, kind: str) -> Column:
    """Identifier that follows ``/<kind>/`` in a link, null if there is none."""
    found = F.regexp_extract(href, rf"/{kind}/(?:\w+/)*?(\w+)/?$", 1)
    return F.nullif(found, F.lit(""))


def composite_key(*parts: Column) -> Column:
    return F.concat(*[p.cast("string") for p in parts])


def race_id_parts(race_id: Column) -> dict[str, Column]:
    """Year, course, meeting, day and race number held in a 12-digit race id."""
    spans = {"round_year": (1, 4), "course_id": (5, 2), "round_count": (7, 2), "round_day": (9, 2), "round": (11, 2)}
    return {name: F.substring(race_id, start, size).try_cast("int") for name, (start, size) in spans.items()}
