"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog import roles
from raceform.catalog.registry import query
from raceform.catalog.roles import iso, t
from raceform.operators import project
from raceform.operators.deviation import population_score


@query("P1_drop_nulls", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return o.na.drop(subset=["status"]).select("o_orderkey", "o_totalprice")


@query("P2_sentinels_to_null", f"""WITH {roles.RAW_RACE} SELECT race_id, horse, horse_number, jockey, popularity, nullif(run_time, '') AS run_time,
  nullif(odds, '---') AS odds, weight FROM raw_race""")
def sentinels_to_null(spark: SparkSession, sf: str) -> DataFrame:
    raw = roles.raw_race(spark, sf).select("race_id", "horse", "horse_number", "jockey", "popularity", "run_time", "odds", "weight")
    return project.sentinels_to_null(raw)


@query("P3_fill_nulls", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Na' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0::DOUBLE ELSE o_totalprice END AS prize FROM orders""")
def fill_nulls(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("prize"),
    )
    return o.na.fill({"status": "Na", "prize": 0.0})


@query("P4_conditional_overwrite", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN '0(0)' ELSE o_orderstatus END AS weight_text FROM orders""")
def conditional_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return t(spark, sf, "orders").select("o_orderkey", F.when(s == "O", F.lit("0(0)")).otherwise(s).alias("weight_text"))


@query("P5_pick_drop_rename", "SELECT o_orderkey AS entry_id, o_custkey AS horse_id, o_orderstatus, o_orderpriority FROM orders")
def pick_drop_rename(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").drop("o_totalprice", "o_orderdate")
    return o.withColumnsRenamed({"o_orderkey": "entry_id", "o_custkey": "horse_id"})


@query("P6_stored_columns", f"WITH {roles.RUNS} SELECT prize, rank, entry_id FROM runs")
def stored_columns(spark: SparkSession, sf: str) -> DataFrame:
    lists = [("base", 0, "prize"), ("base", 1, "rank"), ("base", 2, "entry_id"), ("jockey", 0, "prize"), ("jockey", 1, "date")]
    features = spark.createDataFrame(lists, "feature_set string, position int, name string")
    return project.stored_columns(roles.runs(spark, sf), features, "base")


@query("P7_reconcile", f"WITH {roles.RUNS} SELECT entry_id, 0 AS odds, prize, 0 AS age FROM runs")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return project.reconcile(roles.runs(spark, sf), ["entry_id", "odds", "prize", "age"])


@query("P8_strip_names", "SELECT c_custkey AS horse_id, c_name AS horse_name FROM customer")
def strip_names(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("horse_id "), F.col("c_name").alias(" horse _name"))
    return project.strip_names(c)


@query("P9_prefix_columns", "SELECT c_custkey, c_name AS f_c_name, c_acctbal AS f_c_acctbal FROM customer")
def prefix_columns(spark: SparkSession, sf: str) -> DataFrame:
    return project.prefix_columns(t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "f_", keep=["c_custkey"])


@query("P10_membership", """SELECT o_orderkey, o_custkey FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    keys = t(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return project.in_keys(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query("P12_summary_rows", f"""WITH {roles.RIDES} SELECT jockey_id, CAST(year AS VARCHAR) AS year_text,
  count(*) FILTER (horse_number = 1)::BIGINT AS first FROM rides GROUP BY ALL""")
def summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    totals = roles.jockey_totals(spark, sf)
    return totals.where(F.col("year_text") != "累計").select("jockey_id", "year_text", "first")


@query("P13_top3_filter", f"WITH {roles.RUNS} SELECT entry_id, rank FROM runs WHERE rank < 4")
def top3_filter(spark: SparkSession, sf: str) -> DataFrame:
    return roles.runs(spark, sf).where(F.col("rank") < 4).select("entry_id", "rank")


@query("P14_filter_after_statistic", f"""WITH {roles.SCORES}, s AS (SELECT round, count(*)::DOUBLE AS n,
    sum(CAST(round(p3 * 1000) AS BIGINT))::DOUBLE AS t, sum(CAST(round(p3 * 1000) AS BIGINT) * CAST(round(p3 * 1000) AS BIGINT))::DOUBLE AS q
    FROM scores GROUP BY round)
  SELECT race_id, horse_number, horse_id, jockey_id, quantity,
    CAST(trunc((p3 - t / 1000 / n) / (sqrt((q - t * t / n) / n) / 1000) * 10 + 50) AS BIGINT) AS score
  FROM scores JOIN s USING (round) WHERE date = DATE '1998-03-02'""")
def filter_after_statistic(spark: SparkSession, sf: str) -> DataFrame:
    scored = population_score(roles.scores(spark, sf), "p3", ["round"], "score")
    return scored.where(F.col("date") == F.lit("1998-03-02").cast("date")).select(
        "race_id", "horse_number", "horse_id", "jockey_id", "quantity", "score")


@query("P15_complete_races", """SELECT l_orderkey AS race_id, l_linenumber AS horse_number, l_partkey AS horse_id FROM lineitem
  WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.0 OR l_tax = 0.08)""")
def complete_races(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("horse_number"),
        F.when(F.col("l_discount") != 0.0, F.col("l_partkey")).alias("horse_id"),
        F.when(F.col("l_tax") != 0.08, F.col("l_suppkey")).alias("jockey_id"),
    )
    return project.complete_races(li, "race_id", ["horse_id", "jockey_id"]).select("race_id", "horse_number", "horse_id")


@query("P16_primality", """SELECT o_orderkey, CASE WHEN o_orderkey = 1 THEN false WHEN o_orderkey <= 3 THEN true ELSE
  len(list_filter(range(2, CAST(floor(sqrt(o_orderkey)) AS BIGINT) + 1), lambda k: o_orderkey % k = 0)) = 0 END AS is_prime FROM orders""")
def primality(spark: SparkSession, sf: str) -> DataFrame:
    return project.with_primality(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("P11_one_day", f"WITH {roles.RUNS} SELECT entry_id, strftime(date, '%Y-%m-%d') AS day FROM runs WHERE date = DATE '1998-03-02'")
def one_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.runs(spark, sf).where(F.col("date") == F.lit("1998-03-02").cast("date"))
    return rows.select("entry_id", iso("date").alias("day"))
