import random
import statistics

import pytest
from pyspark.sql import functions as F

from raceform.functions.exact import sum_of_squares
from raceform.operators import deviation, stats


def test_auc_textbook_and_brute_force(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert stats.roc_auc(df, "y", "p").first()["auc"] == 0.75
    r = random.Random(1)
    rows = [(int(r.random() < 0.4), r.choice([0.5, 0.5000001, r.random(), 0.0, 1.0])) for _ in range(400)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert stats.roc_auc(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()["auc"] == pytest.approx(want, rel=1e-12)
    assert stats.roc_auc(df.where("y = 1"), "y", "p").first()["auc"] is None


def test_confusion(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.6), (0, 0.2), (1, 0.4)], "y int, p double")
    assert tuple(stats.confusion(df, "y", "p").first()) == (4, 1, 1, 1, 1, 25.0, 25.0, 25.0, 25.0)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    got = {r["y"]: r["weight"] for r in stats.class_weights(df, "y").collect()}
    assert got == {1: 2.0, 0: pytest.approx(2 / 3)}


def test_time_scores(spark):
    r = random.Random(2)
    xs = [round(r.gauss(100, 5), 1) for _ in range(300)] + [150.0, 50.0]
    df = spark.createDataFrame([(x,) for x in xs], "s double")
    scored, table = stats.time_scores(df, "s", "z")
    m, sd = statistics.mean(xs), statistics.stdev(xs)
    once = [-3 if -(x - m) / sd < -3 else 2 if -(x - m) / sd > 2.5 else -(x - m) / sd for x in xs]
    m2, sd2 = statistics.mean(once), statistics.stdev(once)
    want = sorted((z - m2) / sd2 for z in once)
    assert sorted(x["z"] for x in scored.collect()) == pytest.approx(want, abs=1e-7)
    again = stats.apply_time_scores(df, "s", table, "z")
    assert sorted(x["z"] for x in again.collect()) == sorted(x["z"] for x in scored.collect())


def test_race_deviation(spark):
    rows = [("r", 0.1), ("r", 0.2), ("r", 0.3), ("one", 0.5), ("even", 0.2), ("even", 0.2)]
    df = spark.createDataFrame(rows, "race_id string, p1 double").select("race_id", "p1", *[F.lit(0.1).alias(c) for c in ("p2", "p3", "top3", "expected")])
    got = {(r["race_id"], r["p1"]): r["dev_p1"] for r in deviation.race_deviation(df).collect()}
    assert got == {("r", 0.1): 50.0, ("r", 0.2): 60.0, ("r", 0.3): 70.0, ("one", 0.5): None, ("even", 0.2): None}


def test_population_and_sample_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 5.0), ("c", 5.0)], "g string, x double")
    pop = [(r["g"], r["score"]) for r in deviation.population_score(df, "x", ["g"], "score").collect()]
    assert sorted(pop, key=str) == sorted([("a", 40), ("a", 60), ("b", None), ("c", None), ("c", None)], key=str)
    scaled = [(r["g"], r["z"]) for r in deviation.sample_scale(df, "x", ["g"], "z").collect()]
    assert sorted(z for g, z in scaled if g == "c") == [0.0, 0.0] and [z for g, z in scaled if g == "b"] == [None]


def test_win_rates(spark):
    df = spark.createDataFrame([("j", 1, 1), ("j", 2, 2), ("j", 2, 1), ("j", 3, None), ("k", 1, None), (None, 1, 1)], "jockey string, date int, rank int")
    rate = {(r["jockey"]): r["jockey_win_rate"] for r in stats.with_win_rate(df, "jockey", "rank").collect()}
    assert rate == {"j": pytest.approx(2 / 3), "k": None, None: None}
    before = {(r["jockey"], r["date"]): r["jockey_win_rate"] for r in stats.with_win_rate_before(df, "jockey", "date", "rank").collect()}
    assert before[("j", 1)] is None and before[("j", 2)] == 1.0 and before[("j", 3)] == pytest.approx(2 / 3)


def test_rows_without_group_stay_and_score_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "g string, x double")
    assert {(r.x, r.s) for r in deviation.population_score(df, "x", ["g"], "s").collect()} == {(1.0, 40), (3.0, 60), (2.0, None)}
    assert deviation.sample_scale(df, "x", ["g"], "s").where("g is null").first()["s"] is None


def test_time_scores_of_many_rows(spark):
    df = spark.range(20_000_000).select((60 + F.col("id") % 600 / 10).alias("s"))
    scored, table = stats.time_scores(df, "s")
    second = {r["step"]: r for r in table.collect()}["Second Time"]
    z = [-(i / 10 - 29.95) for i in range(600)]
    assert abs(second["mean"]) < 1e-6 and second["sd"] == pytest.approx(1, abs=1e-6)
    assert scored.agg(F.max("run_time")).first()[0] == pytest.approx(max(z) / statistics.pstdev(z), rel=1e-5)


def test_squares_of_large_whole_numbers(spark):
    values = [0, 1, -3_037_000_499, 3_037_000_500, -(2**62), 2**61 + 1, None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert int(df.agg(sum_of_squares(F.col("v"))).first()[0]) == sum(v * v for v in values if v is not None)
    assert df.where("v is null").agg(sum_of_squares(F.col("v"))).first()[0] is None


def test_rows_without_score_or_group(spark):
    df = spark.createDataFrame([(1, None), (0, 0.3), (1, 0.9), (None, 0.5)], "y int, p double")
    assert stats.roc_auc(df, "y", "p").first()["auc"] == 1.0
    assert tuple(stats.confusion(df, "y", "p").first()) == (2, 1, 0, 1, 0, 50.0, 0.0, 50.0, 0.0)
    groups = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "g string, v double")
    assert sorted([tuple(r) for r in stats.standardise(groups, {"v": 0}, ["g"]).collect()], key=str) == sorted([("a", -1.0), ("a", 1.0), (None, None)], key=str)
