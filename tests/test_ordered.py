import datetime as dt
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from raceform.operators import ordered


def hot_rows(n=600, seed=3):
    """Runs in which one horse holds more than a third of the rows, with ties inside days and nulls."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        horse = "hot" if r.random() < 0.4 else f"h{r.randrange(12)}"
        rows.append((horse, dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(40)), i,
                     None if r.random() < 0.3 else r.randrange(100), float(r.randrange(1000)) / 10))
    return rows


SCHEMA = "horse string, date date, id int, a int, b double"


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(hot_rows(), SCHEMA).cache()


def by_horse(reverse):
    groups = {}
    for row in hot_rows():
        groups.setdefault(row[0], []).append(row)
    return {h: sorted(rs, key=lambda x: (x[1], x[2]), reverse=reverse) for h, rs in groups.items()}


def test_lags_equal_brute_force(runs):
    got = {r["id"]: r for r in ordered.lag_features(runs, "horse", "date", ["id"], ["a", "b"], 5).collect()}
    assert len(got) == 600
    for rows in by_horse(reverse=True).values():
        for i, row in enumerate(rows):
            for lag in range(1, 6):
                want = rows[i + lag] if i + lag < len(rows) else (None,) * 5
                r = got[row[2]]
                assert (r[f"date{lag}"], r[f"a{lag}"], r[f"b{lag}"]) == (want[1], want[3], want[4])


def test_lags_one_per_day_equal_general(spark):
    rows = list({(r[0], r[1]): r for r in hot_rows()}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    a = ordered.lag_features(df, "horse", "date", ["id"], ["a"], 5)
    b = ordered.lag_features(df, "horse", "date", ["id"], ["a"], 5, one_per_day=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_october_follows_september(spark):
    df = spark.createDataFrame([("h", dt.date(2019, 9, 5), 1, 1, 0.0), ("h", dt.date(2019, 10, 5), 2, 2, 0.0)], SCHEMA)
    r = ordered.lag_features(df, "horse", "date", ["id"], ["a"], 1).where("id = 2").first()
    assert (r["date1"], r["a1"]) == (dt.date(2019, 9, 5), 1)


@pytest.mark.parametrize("newest_first", [False, True])
def test_forward_fill_equals_brute_force(runs, newest_first):
    got = {r["id"]: r["a"] for r in ordered.forward_fill(runs, "horse", "date", ["id"], ["a"], newest_first).collect()}
    for rows in by_horse(reverse=newest_first).values():
        last = None
        for row in rows:
            last = row[3] if row[3] is not None else last
            assert got[row[2]] == last


@pytest.mark.parametrize("partitions", [1, 5, 8])
def test_forward_fill_all_and_numbers_across_partitions(runs, partitions):
    got = {r["id"]: r["a"] for r in ordered.forward_fill_all(runs, ["date", "id"], ["a"], partitions).collect()}
    last = None
    for row in sorted(hot_rows(), key=lambda x: (x[1], x[2])):
        last = row[3] if row[3] is not None else last
        assert got[row[2]] == last
    numbers = {r["id"]: r["n"] for r in ordered.number_rows(runs, ["horse"], ["date", "id"], "n", partitions).collect()}
    for rows in by_horse(reverse=False).values():
        assert [numbers[row[2]] for row in rows] == list(range(1, len(rows) + 1))


def test_number_rows_null_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("x", i) for i in range(20)], "k string, i int")
    got = ordered.number_rows(df, ["k"], ["i"], "n", 6).collect()
    assert all(r["n"] == r["i"] + 1 for r in got) and len(got) == 40


def test_last_n(runs):
    got = sorted(r["id"] for r in ordered.last_n(runs, ["horse"], ["date", "id"], 3).collect())
    assert got == sorted(row[2] for rows in by_horse(reverse=True).values() for row in rows[:3])


def test_merge_copies_equals_latest_values(spark):
    r = random.Random(5)
    rows = [(r.randrange(60) if r.random() < 0.6 else -1, i, r.choice([None, "x", "y"]), r.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, 999, "z", 1)], "k int, t int, a string, b int")
    want = {}
    for k, t, a, b in sorted(rows, key=lambda x: x[1]):
        old = want.get(k, (None, None, None))
        want[k] = (t, a or old[1], b or old[2])
    for out in (ordered.merge_copies(df, ["k"], ["t"]), ordered.latest_values(df, ["k"], ["t"])):
        assert {x["k"]: (x["t"], x["a"], x["b"]) for x in out.collect()} == want


@pytest.mark.parametrize("share", [0.3, 0.5, 0.0])
def test_split_by_date(spark, share):
    r = random.Random(9)
    ids = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=3 if r.random() < 0.5 else r.randrange(10))) for i in range(300)]
    rows = [x for x in ids for _ in range(r.randrange(1, 4))]
    out = ordered.split_by_date(spark.createDataFrame(rows, "id int, day date"), "id", "day", share).toPandas()
    order = sorted(ids, key=lambda x: (x[1], hashlib.md5(str(x[0]).encode()).hexdigest()))
    train = {i for i, _ in order[: round(len(order) * (1 - share))]}
    assert len(out) == len(rows)
    assert set(out[out.is_train].id) == train and set(out[~out.is_train].id) == {i for i, _ in ids} - train


def test_rows_without_date_are_split_and_filled(spark):
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2), None, None]
    df = spark.createDataFrame([(i, d, i) for i, d in enumerate(days)] + [(None, days[0], 9)], "id int, date date, v int")
    got = {r["id"]: r["is_train"] for r in ordered.split_by_date(df, "id", "date", 0.4).collect()}
    assert got == {None: True, 0: True, 1: True, 2: False, 3: False}
    rows = spark.createDataFrame([("a", days[0], 0, 5), ("a", None, 1, None), ("b", days[0], 0, None), ("b", None, 1, 7)], "k string, d date, o int, v int")
    filled = {(r["k"], r["o"]): r["v"] for r in ordered.forward_fill(rows, "k", "d", ["o"], ["v"], newest_first=True).collect()}
    # From the newest back, rows without a date come last.
    assert filled == {("a", 0): 5, ("a", 1): 5, ("b", 0): None, ("b", 1): 7}
    first = {(r["k"], r["o"]): r["v"] for r in ordered.forward_fill(rows.withColumn("v", F.when(F.col("d").isNull(), F.lit(4))), "k", "d", ["o"], ["v"]).collect()}
    assert first == {("a", 0): 4, ("a", 1): 4, ("b", 0): 4, ("b", 1): 4}


def test_rows_without_copies_are_not_moved(spark):
    from raceform.operators.ordered import merge_copies

    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "y"), ("b", 1, "z", None), (None, 1, "n", "n")], "k string, at int, u string, v string")
    out = merge_copies(rows, ["k"], ["at"])
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 2, "x", "y"), ("b", 1, "z", None)]
    # One window over all columns was there before; now only the few rows with copies meet.
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_lags_move_rows_before_they_are_packed(spark):
    from raceform.operators.ordered import lag_features

    rows = spark.range(20).select((F.col("id") % 3).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("d"), "id", F.col("id").alias("x"))
    out = lag_features(rows, "k", "d", ["id"], ["x"], 2)
    by_id = {r["id"]: (r["x1"], r["x2"]) for r in out.collect()}
    assert by_id[9] == (6, 3) and by_id[0] == (None, None) and by_id[3] == (0, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [k" in plan
