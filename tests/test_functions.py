import datetime as dt

import pytest
from pyspark.sql import functions as F

from raceform.functions import codes, numeric
from raceform.functions import text as tx
from raceform.operators.pages import recognise_header
from raceform.operators.project import with_primality


def values(spark, expression, inputs, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expression(F.col("x")).alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("expression, inputs, expected", [
    (tx.run_seconds, ["1:34.5", "2:00.0", "59.8", "", None, "x"], [94.5, 120.0, 59.8, None, None, None]),
    (tx.first_corner, ["3-4-10", "7", "", None, "abc"], [3, 7, None, None, None]),
    (tx.final_corner, ["3-4-10", "7", "", None], [10, 7, None, None]),
    (tx.rest_weeks, ["A 中3週 B", "連闘", "x", None, "中12週 連闘"], [3, 1, 0, 0, 12]),
    (tx.body_weight, ["468(+4)", "480(-12)", "500(0)", "470(前計不)", "--", None, "計不"], [468, 480, 500, 470, 0, 0, 0]),
    (tx.body_weight_change, ["468(+4)", "480(-12)", "500(0)", "470(前計不)", "--", None], [4, -12, 0, 0, 0, 0]),
    (lambda c: tx.body_weight(c, "null"), ["468(+4)", "--", None], [468, None, None]),
    (tx.sex, ["牡10"], ["牡"]),
    (tx.age, ["牡10", "牝x"], [10, None]),
    (codes.grade, ["3歳以上500万下", "1600万下", "オープン(L)", "2歳新馬", "3歳未勝利", "障害オープン", "x", None], [4, 6, 7, 3, 1, 0, 0, None]),
    (codes.class_label, ["3歳以上１勝クラス", "1000万下", "x"], ["1勝", "2勝", "不明"]),
    (lambda c: codes.code(c, codes.TRAINING_CODES["lap"]), ["芝", "直", "外", None], [2, 2, None, None]),
    (lambda c: codes.fixed_category(c, codes.CATEGORIES["race_type"]), ["芝", "障害"], ["芝", None]),
    (lambda c: tx.link_id(c, "horse"), ["/horse/2010101234", "https://x/horse/ped/000a0001/", "/jockey/1"], ["2010101234", "000a0001", None]),
])
def test_text(spark, expression, inputs, expected):
    assert values(spark, expression, inputs) == expected


def test_pass_order_mean(spark):
    got = values(spark, tx.pass_order_mean, ["3-4-10", "7", "", None])
    assert got[0] == pytest.approx(17 / 3) and got[1:] == [7.0, None, None]


def test_dates(spark):
    texts = ["2019年7月27日", "2019年12月01日", "2019/07/27", "xx", None]
    assert values(spark, tx.race_date, texts) == [dt.date(2019, 7, 27), dt.date(2019, 12, 1), dt.date(2019, 7, 27), None, None]
    assert values(spark, lambda c: numeric.day_ordinal(tx.race_date(c)), texts[:1]) == [3522]


def test_race_id_parts(spark):
    row = spark.createDataFrame([("202406020211",)], "x string").select(*[c.alias(n) for n, c in tx.race_id_parts(F.col("x")).items()]).first()
    assert tuple(row) == (2024, 6, 2, 2, 11)


def test_clamp_and_buckets(spark):
    assert values(spark, numeric.clamp_z, [-4.0, 2.4, 2.5, 2.6], "double") == [-3.0, 2.4, 2.5, 2.0]
    metres = [1300, 1301, 1899, 1900, 2100, 2101, 2700, 2701]
    assert values(spark, codes.distance_bucket, metres, "int") == ["S", "M", "M", "I", "I", "L", "L", "E"]


def test_probabilities_and_odds(spark):
    df = spark.createDataFrame([(0.6, 0.5, 0.4), (0.0, 0.5, 0.4)], "a double, b double, c double")
    chained = numeric.chained_probabilities(F.col("a"), F.col("b"), F.col("c"))
    rows = df.select(*[c.alias(n) for n, c in chained.items()], numeric.implied_odds(chained["win"]).alias("odds")).collect()
    assert tuple(rows[0]) == (0.6, 0.3, 0.072, 11.111)
    assert rows[1]["odds"] == float("inf")


def test_header_recognition(spark):
    df = spark.createDataFrame([(["芝右1200m", "稍重", "小雨", "2019年7月27日"],), (["障", "芝2000m", "左"],)], "x array<string>")
    a, b = df.select(*[c.alias(n) for n, c in recognise_header(F.col("x")).items()]).collect()
    assert tuple(a) == ("芝", 1200, "稍重", "小雨", "2019年7月27日", "右")
    assert (b["race_type"], b["course_len"], b["weather"], b["course_type"]) == ("芝", 2000, None, "左")


# The primes below 100.
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97]


def test_primes(spark):
    df = with_primality(spark.range(1, 100), "id")
    assert sorted(r["id"] for r in df.where("is_prime").collect()) == PRIMES
    edge = with_primality(spark.createDataFrame([(0,), (-7,), (-8,), (None,)], "id bigint"), "id").collect()
    assert {r["id"]: r["is_prime"] for r in edge if r["id"] is not None} == {0: True, -7: True, -8: True}


def test_large_primes(spark):
    known = {10**12 + 39: True, (10**6 + 3) ** 2: False, 999_983 * 999_979: False, 2**61 - 1: True, 3_215_031_751: False, 3_825_123_056_546_413_051: False, 2**63 - 25: True, 561: False}
    got = with_primality(spark.createDataFrame([(n,) for n in known] * 3 + [(None,)], "id bigint"), "id").collect()
    assert len(got) == 3 * len(known) + 1 and {r["id"]: r["is_prime"] for r in got} == known | {None: None}
