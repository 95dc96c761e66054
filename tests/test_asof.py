import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F
from test_ordered import SCHEMA, hot_rows

from raceform.operators.asof import ALL, FormSpec, form_features, jockey_form, rolling_form

SPEC = FormSpec(metrics={"a": 0, "b": 1}, windows=(3, 7, ALL), avg=("a", "b"), std=("a", "b"), max=("b",), total=("a", "b"), days_since="rest")


def brute(rows, horse, day):
    past = sorted([r for r in rows if r[0] == horse and r[1] < day], key=lambda r: (r[1], r[2]), reverse=True)
    out = {"rest": float((day - past[0][1]).days) if past else None}
    for n in SPEC.windows:
        part = past if n == ALL else past[:n]
        for m, i in (("a", 3), ("b", 4)):
            xs = [r[i] for r in part if r[i] is not None]
            out[f"avg_{m}_{n}"] = sum(xs) / len(xs) if xs else None
            out[f"std_{m}_{n}"] = statistics.stdev(xs) if len(xs) > 1 else None
            out[f"total_{m}_{n}"] = float(sum(xs)) if part else None
            if m == "b":
                out[f"max_{m}_{n}"] = max(xs) if xs else None
    return out


def compare(got, want):
    for name, value in want.items():
        assert got[name] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), name


def test_form_equals_brute_force_with_ties_nulls_and_a_hot_horse(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in form_features(df.select("id", "horse", "date"), df, "horse", "date", ["id"], SPEC).collect()}
    assert len(got) == len(rows)
    for r in rows:
        compare(got[r[2]], brute(rows, r[0], r[1]))


def test_form_of_days_without_runs_and_unknown_horses(spark):
    rows = hot_rows()
    history = spark.createDataFrame(rows, SCHEMA)
    asked = [("hot", dt.date(2020, 1, 1) + dt.timedelta(days=d)) for d in (0, 5, 60, 90)] + [("nobody", dt.date(2020, 3, 1)), (None, dt.date(2020, 3, 1))]
    entries = spark.createDataFrame(asked, "horse string, date date")
    got = form_features(entries, history, "horse", "date", ["id"], SPEC).collect()
    assert len(got) == len(asked)
    for r in got:
        compare(r, brute(rows, r["horse"], r["date"]))


def test_own_day_never_leaks(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [("h", day(i), i, 10 * i, 0.0) for i in (1, 2, 3, 4)]
    spec = FormSpec(metrics={"a": 0}, windows=(3,), avg=("a",), max=("a",), total=("a",))
    for last in (40, 99999):
        history = spark.createDataFrame([*rows[:3], ("h", day(4), 4, last, 0.0)], SCHEMA)
        r = form_features(history.where("id = 4").select("id", "horse", "date"), history, "horse", "date", ["id"], spec).first()
        assert (r["avg_a_3"], r["max_a_3"], r["total_a_3"]) == (20.0, 30.0, 60.0)


def test_rolling_equals_general_on_unique_days(spark):
    rows = list({(r[0], r[1]): r for r in hot_rows()}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    a = form_features(df, df, "horse", "date", ["id"], SPEC)
    b = rolling_form(df, "horse", "date", SPEC).select(*a.columns)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_jockey_form_skips_missing_years(spark):
    yearly = spark.createDataFrame([("j", 2015, 10, 1), ("j", 2018, 20, 2), ("j", 2019, 0, 0), ("j", 2022, 5, 5)], "jockey_id string, year int, starts int, wins int")
    entries = spark.createDataFrame([("j", y) for y in (2015, 2016, 2019, 2021, 2023)] + [("k", 2020)], "jockey_id string, year int")
    pairs = {"rate": ("wins", "starts")}
    two = {(r["jockey_id"], r["year"]): r["rate"] for r in jockey_form(entries, yearly, pairs).collect()}
    assert two == {("j", 2015): None, ("j", 2016): 0.1, ("j", 2019): 0.1, ("j", 2021): 0.1, ("j", 2023): 1.0, ("k", 2020): None}
    every = {r["year"]: r["rate"] for r in jockey_form(entries, yearly, pairs, n=ALL).where("jockey_id = 'j'").collect()}
    assert every[2023] == 8 / 35


def test_deviations_of_very_large_values(spark):
    rows = [("a", dt.date(2020, 1, 1 + i), i, 5_000_000_000 + i * 1000) for i in range(9)]
    df = spark.createDataFrame(rows, "horse string, date date, race int, prize bigint")
    spec = FormSpec(metrics={"prize": 0}, windows=(3, 7, ALL), std=("prize",))
    for got in (form_features(df, df, "horse", "date", ["race"], spec), rolling_form(df, "horse", "date", spec)):
        last = got.where("race = 8").first()
        for n, k in ((3, 3), (7, 7), (ALL, 8)):
            # Squares are exact; the difference of two large doubles is not.
            assert last[f"std_prize_{n}"] == pytest.approx(statistics.stdev(r[3] for r in rows[8 - k : 8]), rel=0.05)
