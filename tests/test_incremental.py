"""Runs that keep their state, against the full modelling table and plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from raceform.operators.encode import LABELS, extend_labels, fit_labels
from raceform.plans import incremental
from raceform.plans.incremental import TIMES, modelling_run
from raceform.plans.modelling import modelling_table
from raceform.schemas import RAW_RACE
from raceform.session import new_path
from raceform.sources import tables
from raceform.sources.keyed import BY_ONE_KEY, KeyedTable
from raceform.sources.runs import RunStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- run store -----------------------------------------------------------------------------------------------------------


def test_rows_become_current_with_the_commit(spark):
    base = new_path(spark, "store")
    schema = "k bigint, v string, p string"
    table = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda: sorted((tuple(r) for r in RunStore(spark, base).read("t", table([]).schema).collect()), key=str)
    store = RunStore(spark, base)
    store.upsert("t", table([(1, "a", "x"), (None, "b", "x"), (2, "c", None), (3, "d", "y/ =%")]), ["k"], "r1", ["p"])
    assert rows() == []
    store.commit("r1", upto="2000")
    assert rows() == sorted([(1, "a", "x"), (None, "b", "x"), (2, "c", None), (3, "d", "y/ =%")], key=str)

    # A run that dies before its commit leaves nothing; its repetition replaces what it wrote.
    RunStore(spark, base).upsert("t", table([(1, "lost", "x"), (9, "lost", "z")]), ["k"], "r2", ["p"])
    assert len(rows()) == 4 and RunStore(spark, base).runs() == ["r1"]
    again = RunStore(spark, base)
    again.upsert("t", table([(None, "B", "x"), (2, "C", None), (4, "e", None)]), ["k"], "r2", ["p"])
    again.commit("r2", upto="2001")
    expected = sorted([(1, "a", "x"), (None, "B", "x"), (2, "C", None), (4, "e", None), (3, "d", "y/ =%")], key=str)
    assert rows() == expected
    assert (again.runs(), again.fact("upto"), again.fact("none")) == (["r1", "r2"], "2001", None)
    with pytest.raises(ValueError):
        again.upsert("t", table([(5, "f", "x")]), ["k"], "r2", ["p"])
    again.upsert("t", table([]), ["k"], "r3", ["p"])
    again.commit("r3")
    assert rows() == expected
    # Only folders that a run touches are written.
    assert tables.folders(spark, f"{base}/t/run=r2", 1) == ["p=__HIVE_DEFAULT_PARTITION__", "p=x"]


# --- dictionary ----------------------------------------------------------------------------------------------------------


def test_codes_never_change(spark):
    draw = random.Random(3)
    base = new_path(spark, "store")
    seen = {"a": {}, "b": {}}
    for run in range(4):
        rows = [(draw.choice([None, "", "Na", *map(str, range(run * 7 + 5))]), draw.choice(["x", None, f"y{run}"]), str(draw.randrange(20))) for _ in range(40)]
        df = spark.createDataFrame(rows, "a string, b string, a1 string").repartition(3)
        store = RunStore(spark, base)
        got = {(r.entity, r.value): r.code for r in extend_labels(store, f"r{run}", df, {"a": ["a", "a1"], "b": ["b"]}).collect()}
        if run == 2:  # dies, and is repeated with a new store
            store = RunStore(spark, base)
            assert got == {(r.entity, r.value): r.code for r in extend_labels(store, f"r{run}", df, {"a": ["a", "a1"], "b": ["b"]}).collect()}
        store.commit(f"r{run}")
        for entity, values in (("a", [r[0] for r in rows] + [r[2] for r in rows]), ("b", [r[1] for r in rows])):
            known = seen[entity]
            new = sorted({v for v in values if v is not None} - set(known))
            start = len(known)
            known.update({v: start + i for i, v in enumerate(new)})
            if run == 0:
                known[None] = start + len(new)
        assert got == {(e, v): c for e, known in seen.items() for v, c in known.items()}
        if run == 0:
            fitted = {(r.entity, r.value): r.code for r in fit_labels(df, {"a": ["a", "a1"], "b": ["b"]}).collect()}
            assert fitted == {k: c for k, c in got.items() if k[1] is not None}
    held = RunStore(spark, base).read("labels", LABELS).where("entity = 'a'")
    assert "PartitionFilters: [isnotnull(entity" in plan(held)


# --- keyed append --------------------------------------------------------------------------------------------------------


def test_keyed_append_reads_only_buckets_of_the_batch(spark):
    path = new_path(spark, "keyed")
    frame = lambda rows: spark.createDataFrame(rows, "a string, b int, v string, day string")
    schema = frame([]).schema
    table = KeyedTable(spark, path, schema, ["a", "b"], ["day"], buckets=8)
    rows = [(f"k{i}", i % 3, "v", f"d{i % 2}") for i in range(300)] + [(None, None, "null", "d0"), (None, 1, "half", None), ("1:a", None, "x", "d0"), ("1", None, "y", "d0")]
    table.append(frame(rows))
    table.append(frame(rows + [("new", 1, "u", "d1"), ("new", 1, "w", "d1"), (None, None, "other", "d9")]))
    again = KeyedTable(spark, path, schema, ["a", "b"], ["day"], buckets=99)
    assert again.buckets == 8
    again.append(frame([("new", 1, "z", "d1")]))
    assert sorted(map(str, (tuple(r) for r in again.read().collect()))) == sorted(map(str, rows + [("new", 1, "w", "d1")]))
    assert spark.read.parquet(path).count() == len(rows) + 1

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(BY_ONE_KEY, "false")
    try:
        new = again.new_rows(frame([("k1", 1, "v", "d1"), ("k9999", 0, "v", "d1")]))
        text = plan(new)
        assert [tuple(r) for r in new.select("a", "b").collect()] == [("k9999", 0)]
    finally:
        spark.conf.set(BY_ONE_KEY, "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    held = text[text.index("Scan parquet spark_catalog"):]
    assert text.count("Exchange") == 1 and "Exchange" not in held
    assert "SelectedBucketsCount: 8 out of 8" not in held and "SelectedBucketsCount" in held and "Bucketed: true" in held


def test_keyed_tables_without_folders_and_values(spark):
    schema = spark.createDataFrame([], "url string").schema
    table = KeyedTable(spark, new_path(spark, "keyed"), schema, ["url"])
    assert table.read().count() == 0
    for _ in range(2):
        table.append(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], schema))
    assert sorted((r.url for r in table.read().collect()), key=str) == [None, "a", "b"] or sorted((str(r.url) for r in table.read().collect())) == ["None", "a", "b"]


# --- modelling runs ------------------------------------------------------------------------------------------------------


def raw_rows(n, seed, first_day, days, arrived):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(first_day + draw.randrange(days))
        text = None if draw.random() < 0.03 else f"{day.year}年{day.month}月{day.day}日"
        row = {f.name: None for f in RAW_RACE.fields}
        row |= {
            "race_id": f"2020{draw.randrange(60):08d}", "horse": f"h{draw.randrange(12)}", "jockey": draw.choice([None, "j1", "j2", f"j{draw.randrange(9)}"]), "horse_number": str(i % 9),
            "run_time": draw.choice(["1:12.3", "1:30.0", "2:01.9", ""]), "odds": "3.5", "pass_order": "1-2", "rank": draw.choice(["1", "2", "5", "中止"]), "weight": 400 + i % 50,
            "weight_change": draw.choice([None, 2]), "gender": "牡", "age": "3", "load": draw.choice(["55.0", "56.5"]), "rise": "34.1", "popularity": "2", "race_name": f"n{i % 4}", "date": text,
            "event": "e", "class": "G1", "turf_or_dirt": "芝", "distance": str(1200 + i % 5 * 200), "lap": "右", "racecourse": "良", "weather": "晴", "place_id": 1, "place_name": "東京",
            "update_at": f"{arrived} 0{draw.randrange(10)}:00:00"}
        out.append(tuple(row[f.name] for f in RAW_RACE.fields))
    return out


def comparable(df):
    names = sorted(df.columns)
    rows = [[round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in names)] for r in df.collect()]
    return names, sorted(rows, key=lambda r: (r[names.index("race_id")], r[names.index("horse")]))


@pytest.mark.parametrize("as_of", [False, True])
def test_runs_equal_the_full_table(spark, as_of):
    path, base = new_path(spark, "raw"), new_path(spark, "store")
    runs = [("2021-01-01", raw_rows(120, 1, 0, 200, "2021-01-01")), ("2021-02-01", raw_rows(50, 2, 250, 60, "2021-02-01")),  # all later
            ("2021-03-01", raw_rows(40, 3, 100, 300, "2021-03-01")), ("2021-04-01", [])]  # late rows and copies of held ones; nothing
    for number, (arrived, rows) in enumerate(runs):
        spark.createDataFrame(rows, RAW_RACE).withColumn("ingest_date", F.to_date(F.substring("update_at", 1, 10))).write.mode("append").partitionBy("ingest_date").parquet(path)
        raw = spark.read.parquet(path)
        store = RunStore(spark, base)
        since = None if not number else f"{arrived} 00:00:00"
        out = modelling_run(raw, store, f"r{number}", since, as_of)
        if number == 1 and not as_of:  # the run dies here and is repeated
            store = RunStore(spark, base)
            out = modelling_run(raw, store, f"r{number}", since, as_of)
        store.commit(f"r{number}")
        full = modelling_table(raw.drop("ingest_date"), since, store.read("times", TIMES), store.read("labels", LABELS), rate_as_of=as_of)
        (names, got), (_, expected) = comparable(out), comparable(full)
        assert names == sorted(full.columns) and len(got) == len(expected)
        for a, b in zip(got, expected, strict=True):
            assert dict(zip(names, a, strict=True)) == dict(zip(names, b, strict=True)), number
        assert bool(rows) == bool(out.count())
        said = {r["name"]: r["value"] for r in store.facts(f"r{number}").collect()}
        assert int(said["rows_made"]) == out.count()


@pytest.mark.parametrize("late", [False, True])
def test_a_run_reads_new_folders_and_touched_tails(spark, monkeypatch, late):
    path, base = new_path(spark, "raw"), new_path(spark, "store")
    dated = RAW_RACE.fieldNames().index("date")
    batches = [raw_rows(80, 5, 0, 100, "2021-01-01"), [r for r in raw_rows(9, 6, 0 if late else 300, 20, "2021-02-01") if r[dated]]]
    # Races of their own, so that no row is a copy.
    batches[1] = [("2021" + r[0][4:], *r[1:]) for r in batches[1]]
    plans = {}
    real, count = incremental.materialize, incremental.counted
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, RAW_RACE).withColumn("ingest_date", F.to_date(F.substring("update_at", 1, 10))).write.mode("append").partitionBy("ingest_date").parquet(path)
        store = RunStore(spark, base)
        if number:
            monkeypatch.setattr(incremental, "materialize", lambda df, label: (plans.update({label: plan(df)}), real(df, label))[1])
            monkeypatch.setattr(incremental, "counted", lambda df, label: (plans.update({label: plan(df)}), count(df, label))[1])
        modelling_run(spark.read.parquet(path), store, f"r{number}", "2021-02-01 00:00:00" if number else None)
        store.commit(f"r{number}")
    assert "PartitionFilters: [isnotnull(ingest_date" in plans["clean"]
    assert "PartitionFilters: [bucket" in plans["touched-tails"]
    assert ("late-raw" in plans) == late
