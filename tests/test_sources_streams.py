import datetime as dt

from pyspark.sql import functions as F

from raceform import session
from raceform.operators import ensembles, ml
from raceform.plans import scoring
from raceform.schemas import URL_COLLECTED
from raceform.session import materialize
from raceform.sources import sinks, tables
from raceform.streaming import jobs


def test_absent_tables_are_typed(spark, tmp_path):
    empty = tables.csv_or_empty(spark, str(tmp_path / "none"), URL_COLLECTED)
    assert empty.schema == URL_COLLECTED and empty.count() == 0
    assert tables.export_columns(spark, "no_such_table", ["a"], str(tmp_path / "x")) is False
    assert not tables.path_exists(spark, str(tmp_path / "x"))


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    for _ in range(3):
        sinks.append_new(df, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_replace_touches_only_given_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string"), path, ["p"])
    sinks.replace(spark.createDataFrame([(9, "b")], "id int, p string"), path, ["p"])
    assert sorted((r["id"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_scans_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"2020-01-0{d} 00:00:00", dt.date(2020, 1, d), 2000 + d) for d in range(1, 7)]
    spark.createDataFrame(rows, "update_at string, ingest_date date, year int").write.partitionBy("year", "ingest_date").parquet(path)
    t = spark.read.parquet(path)
    since = tables.updated_since(t, "2020-01-04 00:00:00", partition="ingest_date")
    assert since.count() == 3
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan
    assert tables.years(t, 2002, 2003).count() == 2
    assert "PartitionFilters: [isnotnull(year" in tables.years(t, 2002, 2003)._jdf.queryExecution().executedPlan().toString()


def test_race_results(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i % 3}", i, f"2020-01-0{i % 2 + 1}") for i in range(12)], "race_id string, n int, date string")
    sinks.race_results(df, str(tmp_path / "o"), tie=["n"])
    for back in (spark.read.parquet(f"{tmp_path}/o/parquet"), spark.read.option("header", True).csv(f"{tmp_path}/o/csv")):
        assert sorted((r["race_id"], int(r["n"]), str(r["date"])) for r in back.collect()) == sorted(map(tuple, df.collect()))


def test_shared_dir_is_the_configured_one(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


SCHEMA = "url string, n int, at timestamp"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)


def test_streams_follow_arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")
    stream = lambda: jobs.files(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
    clean = lambda: jobs.clean_since(stream(), "at", "2024-01-01 00:01:00", f"{tmp_path}/clean", f"{tmp_path}/c1")
    new = lambda: jobs.collect_new(stream(), ["url"], ["at"], f"{tmp_path}/new", f"{tmp_path}/c2", spark.createDataFrame([("old",)], "url string"))
    write(spark, folder, [("a", 1, at(0)), ("b", 2, at(1)), ("a", 3, at(2)), ("old", 4, at(3))])
    clean(), new()
    write(spark, folder, [("a", 5, at(4)), ("c", 6, at(5)), ("c", 7, at(6))])
    clean(), new()
    clean(), new()
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/clean").collect()) == [2, 3, 4, 5, 6, 7]
    assert sorted((r["url"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/new").collect()) == [("a", 1), ("b", 2), ("c", 6)]


def test_requests_are_scored_as_batch_would(spark, tmp_path):
    folder = str(tmp_path / "in")
    features = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("z", 4.0)], "url string, x double")
    scorer = lambda df: df.groupBy("url").agg(F.sum("x").alias("s"))
    write(spark, folder, [("a", 1, at(0)), ("a", 2, at(1))])
    for _ in range(2):
        stream = jobs.files(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
        jobs.score_requests(stream, "url", features, scorer, f"{tmp_path}/out", f"{tmp_path}/c")
        write(spark, folder, [("b", 3, at(2))])
    got = sorted((r["url"], r["s"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 3.0), ("b", 3.0)]


def test_partitioned_writes_do_not_scatter_small_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 8).select("id", (F.col("id") % 5).alias("p"))
    sinks.append(df, str(tmp_path / "t"), ["p"])
    files = [f for d in (tmp_path / "t").iterdir() if d.is_dir() for f in d.glob("*.parquet")]
    assert len(files) == 5 and spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_upsert_keeps_rows_of_earlier_runs(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "race_id string, n int, x int, year int")
    path = f"{tmp_path}/dm"
    sinks.upsert(table([("a", 1, 1, 2000), ("b", 1, 2, 2001), ("b", None, 3, 2001)]), path, ["race_id", "n"], ["year"])
    sinks.upsert(table([("b", 1, 5, 2001), ("c", 1, 6, 2001)]), path, ["race_id", "n"], ["year"])
    got = {tuple(r) for r in spark.read.parquet(path).select("race_id", "n", "x", "year").collect()}
    assert got == {("a", 1, 1, 2000), ("b", None, 3, 2001), ("b", 1, 5, 2001), ("c", 1, 6, 2001)}


def test_upsert_takes_null_for_a_key_and_a_folder(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "race_id string, n int, x int, year int")
    path = f"{tmp_path}/dm"
    for x in (1, 2):
        sinks.upsert(table([("bad", 1, x, None), ("a", None, x, 2000)] if x == 1 else [("bad", 2, x, None), ("a", None, x, 2000)]), path, ["race_id", "n"], ["year"])
    got = {tuple(r) for r in spark.read.parquet(path).select("race_id", "n", "x", "year").collect()}
    assert got == {("bad", 1, 1, None), ("bad", 2, 2, None), ("a", None, 2, 2000)}


def test_keys_in_state_survive_restarts(spark, tmp_path):
    """Equal to the first rows over the union; the seed counts once, null is a key, and the earliest row of a batch wins."""
    folder = str(tmp_path / "in")
    schema = "url string, n int, at timestamp"
    seed = spark.createDataFrame([("old",), ("old",)], "url string")
    run = lambda: jobs.collect_unseen(jobs.files(spark, folder, "*.parquet", spark.read.parquet(folder).schema), ["url"], ["at"], f"{tmp_path}/out", f"{tmp_path}/c", seed)
    for rows in ([("a", 1, at(5)), ("a", 2, at(1)), ("old", 3, at(0)), (None, 4, at(9))], [("a", 5, at(0)), ("b", 6, at(4)), (None, 7, at(0)), ("old", 8, at(1)), ("b", 9, at(3))]):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(folder)
        run(), run()
    assert sorted(((r["url"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == [("a", 2), ("b", 9), (None, 4)]


def test_reports_by_stream_equal_the_batch(spark, tmp_path):
    rows = [(f"r{i // 5}", i % 5 + 1, f"h{i}", 1000 + i // 5 * 400, "turf" if i // 5 % 2 else "dirt", float(i % 5), int(i % 5 < 3), min(i % 5, 3)) for i in range(60)]
    entries = spark.createDataFrame(rows, "race_id string, n int, horse_name string, course_len int, surface string, x double, label int, place int")
    entries = materialize(ml.with_segment(entries, "course_len", "surface"), "entries")
    base, slots = str(tmp_path / "m"), []
    placed, places = ml.train_binary(entries, ["x"], "label", 3, 2), ml.train_places(entries, ["x"], "place", 3, 2)
    for target, model in (("top3", placed), ("top2", placed), ("win", placed), ("place", places)):
        version, path = ml.save_model(model, f"{base}/{target}")
        slots += [(f, target, b, s, version, path) for f in ml.FEATURE_SETS for b in ml.BUCKETS for s in ml.SURFACES]
    ml.register(spark, f"{base}/registry", slots)
    registry = spark.read.parquet(f"{base}/registry")
    models = materialize(ensembles.flatten(spark, [s[5] for s in slots]), "ensembles")
    contract = {"base": ["x"], "jockey": ["x"]}
    folder = str(tmp_path / "in")
    for asked in ([("r1", 0), ("r1", 1), ("nowhere", 2), (None, 3)], [("r3", 4), ("r1", 5)]):
        spark.createDataFrame([(r, i, at(i)) for r, i in asked], "race_id string, i int, at timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.files(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
        jobs.report_requests(stream, "race_id", entries, registry, models, contract, "n", f"{tmp_path}/out", f"{tmp_path}/c", "at")
    batch = scoring.report_rows(entries.where("race_id in ('r1', 'r3')"), registry, models, contract)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").select(*batch.columns).collect()) == sorted(batch.collect())


def test_first_row_of_a_key_is_found_row_by_row():
    from pyspark.sql import Row

    from raceform.streaming.jobs import FirstSeen

    class State:
        held = False

        def exists(self):
            return self.held

        def update(self, value):
            self.held = value[0]

    step = FirstSeen(["at", "n"])
    step.seen = State()
    # Null is last, equal places keep the order of arrival, and rows come one at a time.
    rows = iter([Row(k=1, at=None, n=0), Row(k=1, at=5, n=2), Row(k=1, at=5, n=1)])
    assert list(step.handleInputRows((1,), rows, None)) == [Row(k=1, at=5, n=1)]
    assert list(step.handleInputRows((1,), iter([Row(k=1, at=0, n=0)]), None)) == []
