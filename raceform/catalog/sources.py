"""Scans, sinks and generators."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog import roles
from raceform.catalog.registry import query
from raceform.catalog.roles import iso, t
from raceform.functions.codes import COURSES
from raceform.operators import generate, pages
from raceform.operators.reshape import union_tables
from raceform.schemas import struct
from raceform.session import new_path
from raceform.sources import sinks, tables
from raceform.sources.keyed import KeyedTable
from raceform.sources.runs import RunStore

ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
ORDERS_SCHEMA = struct("o_orderkey bigint, o_custkey bigint, o_totalprice double")


@query("S1_incremental_scan", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS update_at FROM orders
  WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("update_at"))
    return tables.updated_since(o, "1998-01-01 00:00:00")


@query("S1_pruned_scan", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS update_at FROM orders
  WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in folders by the month they arrived; a later scan leaves out the older folders."""
    path = new_path(spark, "by_arrival")
    o = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("update_at"), F.trunc("o_orderdate", "month").alias("arrived"))
    sinks.append(o, path, ["arrived"])
    return tables.updated_since(spark.read.parquet(path), "1998-01-01 00:00:00", partition="arrived").drop("arrived")


@query("S2_year_range_scan", """SELECT l_orderkey, l_partkey, l_quantity, CAST(year(l_shipdate) AS INT) AS year FROM lineitem
  WHERE year(l_shipdate) BETWEEN 1996 AND 1998""")
def year_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "by_year")
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.year("l_shipdate").alias("year"))
    sinks.append(li, path, ["year"])
    return tables.years(spark.read.parquet(path), 1996, 1998)


def _exported(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "export")
    view = f"raceform_export_{uuid4().hex}"
    t(spark, sf, "orders").createOrReplaceTempView(view)
    tables.export_columns(spark, view, ["o_orderkey", "o_custkey", "o_totalprice"], path)
    spark.catalog.dropTempView(view)
    return path


@query("S3_export_columns", ORDERS)
def export_columns(spark: SparkSession, sf: str) -> DataFrame:
    return tables.csv_or_empty(spark, _exported(spark, sf), ORDERS_SCHEMA)


@query("S4_csv_or_empty", ORDERS)
def csv_or_empty(spark: SparkSession, sf: str) -> DataFrame:
    absent = tables.csv_or_empty(spark, new_path(spark, "absent"), ORDERS_SCHEMA)
    present = tables.csv_or_empty(spark, _exported(spark, sf), ORDERS_SCHEMA)
    return union_tables(absent, present)


@query("S5_append_new", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def append_new(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "appended")
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.append_new(o.where(F.col("o_orderstatus") != "P"), path, ["o_orderkey"], ["o_orderstatus"])
    sinks.append_new(o, path, ["o_orderkey"], ["o_orderstatus"])
    sinks.append_new(o, path, ["o_orderkey"], ["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path)


@query("S5_keyed_append", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
  UNION ALL SELECT NULL, 'N', 2""")
def keyed_append(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches over a bucketed table; copies inside a batch are one row, the largest, and null is a key."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = KeyedTable(spark, new_path(spark, "keyed"), o.schema, ["o_orderkey"], ["o_orderstatus"])
    table.append(o.where(F.col("o_orderstatus") != "P"))
    undated = spark.range(3).select(F.lit(None).cast("bigint").alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("id").cast("double").alias("o_totalprice"))
    table.append(o.unionByName(o.withColumn("o_totalprice", F.col("o_totalprice") + 1)).unionByName(undated))
    table.append(o.withColumn("o_totalprice", F.col("o_totalprice") + 9))
    return table.read()


@query("S6_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders""")
def upsert_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs; rows of the second take the place of those with their keys, in a folder without a name, too."""
    store = RunStore(spark, new_path(spark, "store"))
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    for run, rows in (("first", o), ("second", o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2))):
        store.upsert("orders", rows, ["o_orderkey"], run, ["status"])
        store.commit(run)
    return store.read("orders", o.schema)


@query("S6_replace_partitions", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  o_orderstatus FROM orders""")
def replace_partitions(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "replaced")
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.replace(o, path, ["o_orderstatus"])
    sinks.replace(o.where(F.col("o_orderstatus") == "F").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, ["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path)


@query("S7_side_table", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def side_table(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("S8_race_results", f"""WITH {roles.SCORES}, d AS (SELECT race_id, horse_number, p1, strftime(date, '%Y-%m') AS month FROM scores)
  SELECT 'parquet' AS kind, * FROM d UNION ALL SELECT 'csv' AS kind, * FROM d""")
def race_results(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "results")
    df = roles.scores(spark, sf).select("race_id", "horse_number", "p1", F.date_format("date", "yyyy-MM").alias("month"))
    sinks.race_results(df, path, "race_id", "month", ["horse_number"])
    both = {"parquet": spark.read.schema(df.schema).parquet(f"{path}/parquet"),
            "csv": spark.read.schema(df.schema).option("header", True).csv(f"{path}/csv")}
    return union_tables(*[d.withColumn("kind", F.lit(k)) for k, d in both.items()])


@query("S9_surface_history", f"""WITH {roles.SCORES} SELECT race_id, horse_number, p1, surface FROM scores WHERE surface = 'F'""")
def surface_history(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "by_surface")
    df = roles.scores(spark, sf).select("race_id", "horse_number", "p1", "surface")
    sinks.replace(df, path, ["surface"])
    return tables.surface_history(spark.read.schema(df.schema).parquet(path), "F")


@query("S10_before_day", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < DATE '1997-07-01'""")
def before_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.before_day(t(spark, sf, "orders"), "1997-07-01", "o_orderdate")
    return rows.select("o_orderkey", iso("o_orderdate").alias("day"))


@query("S11_page_source", r"""SELECT page_id, url, len(regexp_extract_all(html, '<p>')) AS paragraphs,
  len(regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>')) AS items FROM pages""")
def page_source(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "pages")
    return p.select(
        "page_id", "url", F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).cast("bigint").alias("paragraphs"),
        F.size(pages.inner(F.col("html"), "li")).cast("bigint").alias("items"),
    )


@query("S13_records", "SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_acctbal': c_acctbal}) AS record FROM customer")
def records(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.records(t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))


def _seasons(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return t(spark, sf, "supplier").select((s % 7 + 1995).cast("int").alias("year"), (s + 1).alias("course_id"), F.col("s_name").alias("place"))


def _candidates_sql(day: str) -> str:
    two = "CASE WHEN length({0}) < 2 THEN lpad({0}, 2, '0') ELSE {0} END"
    course = two.format("CAST(s_suppkey + 1 AS VARCHAR)")
    return f"""SELECT concat('{generate.PAGE_PREFIX}', id) AS url, id AS current_race_id, CAST(s_suppkey AS INT) AS racecourse_i,
      s_name AS place, CAST(r AS INT) AS race_number_i, CAST(1995 + s_suppkey % 7 AS INT) AS year
    FROM (SELECT *, concat(1995 + s_suppkey % 7, {course}, lpad(CAST(m + 1 AS VARCHAR), 2, '0'), {day},
        lpad(CAST(r + 1 AS VARCHAR), 2, '0')) AS id
      FROM supplier, range(7) a(m), range(13) b(d), range(12) c(r)) q"""


@query("G1_candidate_pages", _candidates_sql("lpad(CAST(d + 1 AS VARCHAR), 2, '0')"))
def candidate_pages(spark: SparkSession, sf: str) -> DataFrame:
    return generate.candidate_pages(_seasons(spark, sf))


@query("G1_candidate_pages_literal", _candidates_sql("concat('0', d + 1)"))
def candidate_pages_literal(spark: SparkSession, sf: str) -> DataFrame:
    return generate.candidate_pages(_seasons(spark, sf), literal_ids=True)


@query("G2_course_dimension", f"""SELECT s_suppkey, place FROM supplier JOIN (VALUES {', '.join(f"({k}, '{v}')" for k, v in COURSES.items())})
  c(course_id, place) ON s_suppkey % 10 + 1 = course_id""")
def course_dimension(spark: SparkSession, sf: str) -> DataFrame:
    s = t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10 + 1).alias("course_id"))
    return s.join(F.broadcast(generate.courses(spark)), "course_id").select("s_suppkey", "place")
