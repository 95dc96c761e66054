import pytest
from pyspark.sql import functions as F

from raceform.operators import encode, generate, joins, project, reshape


def test_not_collected(spark):
    cand = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    seen = spark.createDataFrame([("b",), ("b",)], "url string")
    assert sorted(r["url"] for r in joins.not_collected(cand, seen).collect()) == ["a", "c"]
    assert joins.not_collected(cand, seen.limit(0)).count() == 3


def test_lookup_last_and_default(spark):
    past = spark.createDataFrame([("k", 1, 40.0), ("k", 2, 60.0)], "key string, pos int, score double")
    now = spark.createDataFrame([("k",), ("x",)], "key string")
    got = {r["key"]: r["score"] for r in joins.lookup_last(now, past, ["key"], "score", ["pos"]).collect()}
    assert got == {"k": 60.0, "x": 50.0}


def test_impute_body_weight(spark):
    entries = spark.createDataFrame([("r1", "a", None), ("r1", "b", "480(+2)"), ("r2", "a", "470(0)"), ("r1", "new", "1(0)")], "race string, horse string, text string")
    history = spark.createDataFrame([("a", 471, -3), ("a", 472, -4), ("b", 500, None)], "horse string, weight int, change int")
    got = {(r["race"], r["horse"]): r["text"] for r in joins.impute_body_weight(entries, history, "race", "horse", "text", "weight", "change").collect()}
    assert got == {("r1", "a"): "471(-3)", ("r1", "b"): None, ("r2", "a"): "470(0)", ("r1", "new"): None}


def test_roles(spark):
    entries = spark.createDataFrame([(1, "x", None), (2, "y", "x")], "id int, sire string, grandsire string")
    stats = spark.createDataFrame([("x", 5), ("y", 6)], "key string, v int")
    got = {r["id"]: (r["f_v"], r["ff_v"]) for r in joins.attach_roles(entries, stats, "key", {"f_": "sire", "ff_": "grandsire"}).collect()}
    assert got == {1: (5, None), 2: (6, 5)}


def test_candidates(spark):
    padded = generate.season_candidates(spark, 2019, 2019)
    literal = generate.season_candidates(spark, 2019, 2019, literal_ids=True)
    sizes = lambda df: {r["n"]: r["count"] for r in df.groupBy(F.length("current_race_id").alias("n")).count().collect()}
    assert sizes(padded) == {12: 10920} and sizes(literal) == {12: 7560, 13: 3360}
    assert literal.select("current_race_id").distinct().count() == 10920
    first = padded.where("current_race_id = '201901010101'").first()
    assert (first["racecourse_i"], first["place"], first["race_number_i"]) == (0, "札幌", 0)


def test_projections(spark):
    df = spark.createDataFrame([("", "---", 1), ("x", "y", 2)], "a string, b string, c int")
    assert [tuple(r) for r in project.sentinels_to_null(df).orderBy("c").collect()] == [(None, None, 1), ("x", "y", 2)]
    assert project.reconcile(df, ["c", "d"]).columns == ["c", "d"]
    assert project.strip_names(df.toDF("a ", " b", "c d")).columns == ["a", "b", "cd"]
    full = project.complete_races(spark.createDataFrame([("r", 1), ("r", None), ("s", 2)], "race string, id int"), "race", ["id"])
    assert [r["race"] for r in full.collect()] == ["s"]


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    vocabulary = encode.fit_labels(df, {"x": ["x"]})
    got = [r["x"] for r in encode.apply_labels(df.withColumn("o", F.col("x")), vocabulary, {"x": ["x"]}).orderBy(F.col("o").asc_nulls_last()).collect()]
    assert got == [0, 1, 2, 3]
    unknown = spark.createDataFrame([("zz",)], "x string")
    assert encode.apply_labels(unknown, vocabulary, {"x": ["x"]}).first()["x"] is None
    filled = encode.fit_labels(df, {"x": ["x"]}, "Na")
    assert {r["value"]: r["code"] for r in filled.collect()} == {"Na": 0, "a": 1, "b": 2, "c": 3}


def test_dummies_refuse_wide_columns(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("x"))
    with pytest.raises(ValueError):
        encode.fit_dummies(df, ["x"], limit=10)
    out = encode.apply_dummies(df, {"x": ["1", "2"]})
    assert out.columns == ["x_1", "x_2"] and out.agg(F.sum("x_1")).first()[0] == 1


def test_pedigree(spark):
    """Full tree: generation g of a page with 32 rows repeats each of its 2^(g+1) names."""
    rows = [("h", r, *[f"g{g}n{r // 2 ** (4 - g)}" for g in range(5)]) for r in range(32)]
    rows += [("dup", r, "s" if r < 16 else "t", *[f"{g}" for g in range(1, 5)]) for r in range(32)]
    tree = spark.createDataFrame(rows, "horse string, row int, a string, b string, c string, d string, e string")
    long = reshape.flatten_pedigree(tree, "horse", "row", list("abcde"))
    got = [r["ancestor"] for r in long.where("horse = 'h'").orderBy("pos").collect()]
    assert got == [f"g{g}n{n}" for g in range(5) for n in range(2 ** (g + 1))]
    # Repeated paths count once per generation; the last generation keeps every row.
    dup = [r["ancestor"] for r in long.where("horse = 'dup'").orderBy("pos").collect()]
    assert dup == ["s", "t", "1", "1", "2", "2", "3", "3", *["4"] * 32]
    wide = reshape.pivot_pedigree(long, "horse").where("horse = 'h'").first()
    assert wide["peds_0"] == "g0n0" and wide["peds_61"] == "g4n31"


def test_unpivot_and_split(spark):
    wide = spark.createDataFrame([("j", 1, 2, 3, 4)], "j string, ts int, tw int, ds int, dw int")
    got = reshape.unpivot_categories(wide, ["j"], {"turf": ["ts", "tw"], "dirt": ["ds", "dw"]}, ["starts", "wins"])
    assert sorted(tuple(r) for r in got.collect()) == [("j", "dirt", 3, 4), ("j", "turf", 1, 2)]
    parts = reshape.split_columns(spark.createDataFrame([("3-4",)], "x string"), "x", "-", ["a", "b", "c"]).first()
    assert tuple(parts) == ("3-4", "3", "4", None)


def test_dummies_of_any_width(spark):
    from pyspark.ml.functions import vector_to_array

    from raceform.operators import encode

    wide = spark.range(50_000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"), F.lit(None).cast("string").alias("nothing"), F.col("id").alias("n"))
    fitted = encode.fit_sparse_dummies(wide, ["a", "b", "nothing"])
    assert fitted.sizes == {"a": 50_000, "b": 3, "nothing": 0}
    asked = spark.createDataFrame([("7", "1", None, 1), ("unknown", None, "x", 2)], "a string, b string, nothing string, n bigint")
    got = {r["n"]: r["dummies"] for r in encode.apply_sparse_dummies(asked, fitted).collect()}
    codes = {(r["entity"], r["value"]): r["code"] for r in fitted.vocabulary.where("value in ('7', '1')").collect()}
    assert got[1].size == got[2].size == 50_003
    assert sorted(got[1].indices) == [codes["a", "7"], 50_000 + codes["b", "1"]] and len(got[2].indices) == 0
    assert encode.apply_sparse_dummies(wide, fitted).count() == 50_000
    alone = encode.apply_sparse_dummies(asked.select("nothing", "n"), encode.fit_sparse_dummies(wide, ["nothing"]))
    assert [r["v"] for r in alone.select(vector_to_array("dummies").alias("v")).collect()] == [[], []]


def test_sparse_dummies_are_read_without_being_laid_out(spark):
    from pyspark.ml.linalg import Vectors

    from raceform.operators import encode

    vocabulary = spark.createDataFrame([("a", "x", 1_999_999_998), ("b", "y", 2)], "entity string, value string, code bigint")
    fitted = encode.SparseDummies(vocabulary, {"a": 2_000_000_000, "b": 3})
    rows = spark.createDataFrame([("x", "y", 1), ("other", "others", 2)], "a string, b string, n bigint")
    v = F.col("dummies")
    out = encode.apply_sparse_dummies(rows, fitted).select("n", encode.set_places(v).alias("at"), encode.vector_width(v).alias("width"))
    assert {r["n"]: (r["at"], r["width"]) for r in out.collect()} == {1: ([1_999_999_998, 2_000_000_002], 2_000_000_003), 2: ([], 2_000_000_003)}
    dense = spark.createDataFrame([(Vectors.dense([0, 1, 0, 1]),)], ["dummies"])
    assert dense.select(encode.set_places(v).alias("at"), encode.vector_width(v).alias("width")).first() == ([1, 3], 4)


def test_pedigree_pages_move_once(spark):
    tree = spark.range(200).select((F.col("id") % 50).alias("horse"), F.col("id").alias("row"), *[F.concat(F.lit("a"), (F.col("id") % 2**g).cast("string")).alias(f"g{g}") for g in range(5)])
    flat = reshape.flatten_pedigree(tree, "horse", "row", [f"g{g}" for g in range(5)])
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    gaps = spark.createDataFrame([(1, 0, None, "x"), (1, 1, None, "y"), (1, 2, "b", None), (1, 2, "b", None)], "horse int, row int, g0 string, g1 string")
    assert [tuple(r) for r in reshape.flatten_pedigree(gaps, "horse", "row", ["g0", "g1"]).orderBy("pos").collect()] == [
        (1, 0, None), (1, 1, "b"), (1, 2, "x"), (1, 3, "y"), (1, 4, None)]


def test_candidates_of_one_partition_are_made_by_many_tasks(spark):
    seasons = spark.createDataFrame([(1990 + i, 3, "x") for i in range(40)], "year int, course_id int, place string").coalesce(1)
    pages = generate.candidate_pages(seasons)
    assert pages.select(F.spark_partition_id()).distinct().count() > 1
    assert (pages.count(), pages.select("url").distinct().count()) == (40 * 1092, 40 * 1092)
