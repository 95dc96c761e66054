"""Set operations, reshaping and encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog import roles
from raceform.catalog.registry import query
from raceform.catalog.roles import t
from raceform.operators import encode, reshape
from raceform.session import new_path
from raceform.sources.runs import RunStore


@query("U1_union_history", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def union_history(spark: SparkSession, sf: str) -> DataFrame:
    history = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    current = t(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return reshape.union_tables(history, current)


@query("U2_keyed_union", """SELECT 'open' AS kind, o_orderkey, o_custkey, NULL::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT 'closed', o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def keyed_union(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    return reshape.keyed_union({
        "open": o.where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_custkey"),
        "closed": o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice"),
    }, "kind")


@query("X1_split_columns", """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, nullif(split_part(o_orderpriority, '-', 2), '') AS b, NULL::VARCHAR AS c FROM orders""")
def split_columns(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return reshape.split_columns(o, "o_orderpriority", "-", ["a", "b", "c"]).drop("o_orderpriority")


@query("X2_dummies", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS "o_orderstatus_F", CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
  CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P" FROM orders""")
def dummies(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.apply_dummies(o, encode.fit_dummies(o, ["o_orderstatus"]))


@query("X2_sparse_dummies", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS c, o_orderstatus AS s FROM orders), n AS (SELECT count(DISTINCT c) AS n, count(DISTINCT s) AS m FROM o),
    v AS (SELECT c AS value, dense_rank() OVER (ORDER BY CAST(c AS VARCHAR)) - 1 AS code FROM (SELECT DISTINCT c FROM o WHERE c IS NOT NULL) q)
  SELECT o_orderkey, CAST(code AS INT) AS customer_at, CAST(n + dense_rank() OVER (ORDER BY s) - 1 AS INT) AS status_at, CAST(n + m AS INT) AS width, CASE WHEN c IS NULL THEN 1 ELSE 2 END AS n_set
  FROM o LEFT JOIN v ON value = c, n""")
def sparse_dummies(spark: SparkSession, sf: str) -> DataFrame:
    """As many categories as there are customers."""
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey")).alias("customer"), F.col("o_orderstatus").alias("status"))
    fitted = encode.fit_sparse_dummies(o, ["customer", "status"])
    vectors = encode.apply_sparse_dummies(o, fitted)
    placed = vectors.select("o_orderkey", encode.set_places(F.col("dummies")).alias("at"), encode.vector_width(F.col("dummies")).alias("width"))
    first = F.lit(fitted.sizes["customer"])
    return placed.select("o_orderkey", F.get(F.filter("at", lambda i: i < first), F.lit(0)).alias("customer_at"),
                         F.get(F.filter("at", lambda i: i >= first), F.lit(0)).alias("status_at"), "width", F.size("at").alias("n_set"))


@query("X3_pivot", "SELECT l_partkey AS horse_id, " + ", ".join(f"max(ancestor) FILTER (pos = {i}) AS peds_{i}" for i in range(7))
       + " FROM (SELECT l_partkey, l_linenumber - 1 AS pos, concat(l_returnflag, l_suppkey) AS ancestor FROM lineitem) q GROUP BY 1")
def pivot(spark: SparkSession, sf: str) -> DataFrame:
    long = t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("horse_id"), (F.col("l_linenumber") - 1).alias("pos"),
        F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("ancestor"))
    return reshape.pivot_pedigree(long, "horse_id", 7)


@query("X5_unpivot", f"""WITH {roles.RIDES}, w AS (SELECT jockey_id, year, count(*) FILTER (surface = 'turf')::BIGINT AS ts, count(*) FILTER (surface = 'turf' AND l_discount >= 0.05)::BIGINT AS tw,
    count(*) FILTER (surface = 'dirt')::BIGINT AS ds, count(*) FILTER (surface = 'dirt' AND l_discount >= 0.05)::BIGINT AS dw FROM rides GROUP BY ALL)
  SELECT jockey_id, year, 'turf' AS category, ts AS starts, tw AS wins FROM w UNION ALL SELECT jockey_id, year, 'dirt', ds, dw FROM w""")
def unpivot(spark: SparkSession, sf: str) -> DataFrame:
    from raceform.operators.asof import jockey_year_wide

    wide = jockey_year_wide(roles.jockey_long(spark, sf)).na.fill(0)
    groups = {c: [f"{c}_starts", f"{c}_wins"] for c in ("turf", "dirt")}
    return reshape.unpivot_categories(wide, ["jockey_id", "year"], groups, ["starts", "wins"])


_JOCKEY = "CASE WHEN o_orderkey % 10 > 0 THEN concat('J', o_custkey) END"


@query("F6_label_codes", f"""SELECT o_orderkey, CASE WHEN j IS NULL THEN (SELECT count(DISTINCT j) FROM (SELECT {_JOCKEY} AS j FROM orders) n)
    ELSE dense_rank() OVER (ORDER BY j NULLS LAST) - 1 END AS jockey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS priority
  FROM (SELECT *, {_JOCKEY} AS j FROM orders) o""")
def label_codes(spark: SparkSession, sf: str) -> DataFrame:
    jockey = F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("J"), F.col("o_custkey").cast("string")))
    o = t(spark, sf, "orders").select("o_orderkey", jockey.alias("jockey"), F.col("o_orderpriority").alias("priority"))
    entities = {"jockey": ["jockey"], "priority": ["priority"]}
    return encode.apply_labels(o, encode.fit_labels(o, entities), entities)


def _batches_sql(column: str, name: str) -> str:
    """Codes of two batches: values of the first in sort order, null, then the new values of the second in sort order."""
    return f"""{name}_v AS (SELECT {column} AS value, min(o_orderkey % 2) AS batch FROM o WHERE {column} IS NOT NULL GROUP BY 1),
      {name}_c AS (SELECT value, row_number() OVER (ORDER BY batch, value) - 1 + batch AS code FROM {name}_v
        UNION ALL SELECT NULL, count(*) FILTER (batch = 0) FROM {name}_v)"""


@query("F6_two_batches", f"""WITH o AS (SELECT *, {_JOCKEY} AS j FROM orders WHERE o_orderkey % 2 = 1 OR o_custkey % 3 = 0), {_batches_sql("j", "jockey")}, {_batches_sql("o_orderpriority", "priority")}
  SELECT o_orderkey, jockey_c.code AS jockey, priority_c.code AS priority FROM o JOIN jockey_c ON jockey_c.value IS NOT DISTINCT FROM j JOIN priority_c ON priority_c.value = o_orderpriority""")
def two_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches and one dictionary: what the first fitted never moves, so its rows are coded by the codes it had."""
    jockey = F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("J"), F.col("o_custkey").cast("string")))
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", jockey.alias("jockey"), F.col("o_orderpriority").alias("priority"))
    entities, base, out = {"jockey": ["jockey"], "priority": ["priority"]}, new_path(spark, "store"), []
    for number, rows in enumerate((o.where("o_orderkey % 2 = 0 and o_custkey % 3 = 0"), o.where("o_orderkey % 2 = 1"))):
        store = RunStore(spark, base)
        dictionary = encode.extend_labels(store, f"batch-{number}", rows, entities)
        out.append(encode.apply_labels(rows.drop("o_custkey"), dictionary, entities))
        store.commit(f"batch-{number}")
    return out[0].unionByName(out[1])


@query("F6_label_codes_null_text", f"""SELECT o_orderkey, dense_rank() OVER (ORDER BY coalesce({_JOCKEY}, 'Na')) - 1 AS jockey FROM orders""")
def label_codes_null_text(spark: SparkSession, sf: str) -> DataFrame:
    jockey = F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("J"), F.col("o_custkey").cast("string")))
    o = t(spark, sf, "orders").select("o_orderkey", jockey.alias("jockey"))
    entities = {"jockey": ["jockey"]}
    return encode.apply_labels(o, encode.fit_labels(o, entities, "Na"), entities, "Na")


@query("F6_shared_codes", """WITH v AS (SELECT p AS value, row_number() OVER (ORDER BY p) - 1 AS code FROM (
    SELECT concat('K', l_partkey) AS p FROM lineitem UNION SELECT concat('K', l_suppkey) FROM lineitem) u)
  SELECT l_orderkey, l_linenumber, l_quantity, a.code AS now, b.code AS before FROM lineitem JOIN v a ON a.value = concat('K', l_partkey) JOIN v b ON b.value = concat('K', l_suppkey)""")
def shared_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of one entity share codes."""
    li = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("now"),
        F.concat(F.lit("K"), F.col("l_suppkey").cast("string")).alias("before"))
    entities = {"horse": ["now", "before"]}
    return encode.apply_labels(li, encode.fit_labels(li, entities), entities)
