"""Aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog import roles
from raceform.catalog.joins import CATEGORY_PAIRS, _stat_sql
from raceform.catalog.registry import query
from raceform.catalog.roles import iso, t
from raceform.functions import text as tx
from raceform.functions.numeric import row_sum
from raceform.operators import stats
from raceform.operators.asof import ALL, FormSpec, form_features, jockey_year_wide
from raceform.operators.ordered import latest_values, merge_copies
from raceform.operators.project import sentinels_to_null


def _single(kind: str, metric: str, decimals: int) -> tuple[FormSpec, str]:
    spec = FormSpec(metrics={metric: decimals}, windows=(3, 5, 7, ALL), **{kind: (metric,)})
    cols = ", ".join(x for n in spec.windows for x in _stat_sql(metric, decimals, n, spec))
    sql = f"""WITH {roles.RUNS}, past AS (SELECT e.entry_id AS id, h.*, row_number() OVER (PARTITION BY e.entry_id ORDER BY h.date DESC, h.entry_id DESC) AS rn
      FROM runs e JOIN runs h ON e.horse_id = h.horse_id AND h.date < e.date), f AS (SELECT id, {cols} FROM past GROUP BY id)
      SELECT entry_id, f.* EXCLUDE (id) FROM runs LEFT JOIN f ON id = entry_id"""
    return spec, sql


def _add_single(name: str, kind: str, metric: str, decimals: int) -> None:
    spec, sql = _single(kind, metric, decimals)

    def build(spark: SparkSession, sf: str) -> DataFrame:
        history = roles.runs(spark, sf)
        out = form_features(history.select("entry_id", "horse_id", "date"), history, "horse_id", "date", ["entry_id"], spec)
        return out.drop("horse_id", "date")

    query(name, sql)(build)


_add_single("A1_form_means", "avg", "last3f", 1)
_add_single("A2_form_deviations", "std", "prize", 2)
_add_single("A3_form_max", "max", "prize", 2)
_add_single("A4_form_totals", "total", "prize", 2)


@query("A5_category_rates", f"""WITH {roles.RIDES}, c AS (SELECT jockey_id, kind AS category, l_discount FROM rides UNION ALL SELECT jockey_id, surface, l_discount FROM rides)
  SELECT jockey_id, {', '.join(f"count(*) FILTER (category = '{c}' AND l_discount >= 0.05)::DOUBLE / nullif(count(*) FILTER (category = '{c}'), 0) AS {c}_win_rate"
                               for c in ('graded', 'special', 'regular', 'turf', 'dirt'))} FROM c GROUP BY jockey_id""")
def category_rates(spark: SparkSession, sf: str) -> DataFrame:
    wide = jockey_year_wide(roles.jockey_long(spark, sf))
    return wide.groupBy("jockey_id").agg(*[
        F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")).alias(name) for name, (a, b) in CATEGORY_PAIRS.items()
    ])


@query("A6_win_rates", f"""WITH {roles.RIDES} SELECT jockey_id, count(*) FILTER (horse_number = 1)::DOUBLE / count(*) AS win_rate,
  count(*) FILTER (horse_number <= 3)::DOUBLE / count(*) AS top3_rate FROM rides GROUP BY jockey_id""")
def win_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.rides(spark, sf)
    n = F.count(F.lit(1)).cast("double")
    return r.groupBy("jockey_id").agg(
        (F.count_if(F.col("horse_number") == 1).cast("double") / n).alias("win_rate"),
        (F.count_if(F.col("horse_number") <= 3).cast("double") / n).alias("top3_rate"))


@query("A7_global_win_rate", f"""WITH {roles.RIDES} SELECT jockey_id, count(*) FILTER (n = 1)::DOUBLE / nullif(count(n), 0) AS win_rate
  FROM (SELECT jockey_id, CASE WHEN l_discount > 0 THEN horse_number END AS n FROM rides) q GROUP BY jockey_id""")
def global_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("l_discount") > 0, F.col("horse_number"))
    return roles.rides(spark, sf).groupBy("jockey_id").agg(stats.win_rate(rank).alias("win_rate"))


@query("A8_last_values", """WITH h AS (SELECT o_custkey, o_orderdate, o_orderkey, nullif(o_orderstatus, 'P') AS status,
    CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS prize FROM orders)
  SELECT o_custkey, arg_max(status, (o_orderdate, o_orderkey)) FILTER (status IS NOT NULL) AS status,
    arg_max(prize, (o_orderdate, o_orderkey)) FILTER (prize IS NOT NULL) AS prize FROM h GROUP BY o_custkey""")
def last_values(spark: SparkSession, sf: str) -> DataFrame:
    h = t(spark, sf, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("prize"))
    return latest_values(h, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["status", "prize"])


_ORDER = "(update_at, horse_number, jockey, popularity)"
_DEDUPED = ("run_time", "odds", "rank", "weight", "date", "horse_number", "jockey", "popularity", "update_at")


@query("A9_dedupe_runners", f"""WITH {roles.RAW_RACE}, k AS (SELECT race_id, horse, update_at, horse_number, jockey, popularity, weight, date, rank,
    nullif(run_time, '') AS run_time, nullif(odds, '---') AS odds FROM raw_race)
  SELECT race_id, horse, {', '.join(f'arg_max({c}, {_ORDER}) FILTER ({c} IS NOT NULL) AS {c}' for c in _DEDUPED)} FROM k GROUP BY race_id, horse""")
def dedupe_runners(spark: SparkSession, sf: str) -> DataFrame:
    raw = sentinels_to_null(roles.raw_race(spark, sf)).select("race_id", "horse", *_DEDUPED)
    return merge_copies(raw, ["race_id", "horse"], ["update_at", "horse_number", "jockey", "popularity"])


@query("A10_mean_body_weight", """SELECT l_partkey AS horse_id, avg(l_partkey % 150 + 400 + l_linenumber) AS weight, avg(l_suppkey % 21 - 10) AS weight_change
  FROM lineitem GROUP BY 1""")
def mean_body_weight(spark: SparkSession, sf: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return t(spark, sf, "lineitem").groupBy(part.alias("horse_id")).agg(
        F.avg(part % 150 + 400 + F.col("l_linenumber")).alias("weight"), F.avg(supp % 21 - 10).alias("weight_change"))


_MOMENTS = """n AS (SELECT count(u)::DOUBLE AS k, sum(u)::DOUBLE AS s, sum(u::HUGEINT * u)::DOUBLE AS q
  FROM (SELECT CAST(round({x} * {unit}) AS BIGINT) AS u FROM {table}) z)"""


@query("A11_mean_and_sd", f"""WITH {_MOMENTS.format(x='o_totalprice', unit='100', table='orders')}
  SELECT s / 100 / k AS mean, sqrt(greatest((q - s * s / k) / (k - 1), 0)) / 100 AS sd FROM n""")
def mean_and_sd(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mean_and_std(t(spark, sf, "orders"), "o_totalprice", 2)


def _two_step_sql(last: str) -> str:
    """Seconds = quantity + suppkey / 10, standardised, clamped, standardised again."""
    return f"""WITH src AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + CAST(l_suppkey % 10 AS DOUBLE) / 10 AS seconds FROM lineitem),
    n1 AS (SELECT count(u)::DOUBLE AS k, sum(u)::DOUBLE AS s, sum(u::HUGEINT * u)::DOUBLE AS q FROM (SELECT CAST(round(seconds * 10) AS BIGINT) AS u FROM src) z),
    m1 AS (SELECT s / 10 / k AS mean, sqrt(greatest((q - s * s / k) / (k - 1), 0)) / 10 AS sd FROM n1),
    z1 AS (SELECT src.*, -((seconds - mean) / sd) AS z FROM src, m1),
    c1 AS (SELECT * EXCLUDE (z), round(CASE WHEN z < -3 THEN -3 WHEN z > 2.5 THEN 2 ELSE z END, 9) AS z FROM z1),
    n2 AS (SELECT count(u)::DOUBLE AS k, sum(u)::DOUBLE AS s, sum(u::HUGEINT * u)::DOUBLE AS q FROM (SELECT CAST(round(z * 1000000000) AS BIGINT) AS u FROM c1) z),
    m2 AS (SELECT s / 1000000000 / k AS mean, sqrt(greatest((q - s * s / k) / (k - 1), 0)) / 1000000000 AS sd FROM n2) {last}"""


def _seconds(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") + F.col("l_suppkey") % 10 / 10).alias("seconds"))


@query("A12_time_statistics", _two_step_sql("SELECT 'First Time' AS step, mean, sd FROM m1 UNION ALL SELECT 'Second Time', round(mean, 9) + 0.0::DOUBLE, sd FROM m2"))
def time_statistics(spark: SparkSession, sf: str) -> DataFrame:
    table = stats.time_scores(_seconds(spark, sf), "seconds", "run_time")[1]
    return table.withColumn("mean", F.when(F.col("step") == "Second Time", F.round("mean", 9)).otherwise(F.col("mean")))


@query("F8_time_scores", _two_step_sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seconds, round((z - mean) / sd, 9) AS run_time FROM c1, m2"))
def time_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = stats.time_scores(_seconds(spark, sf), "seconds", "run_time")
    return scored.withColumn("run_time", F.round("run_time", 9))


@query("F8_time_scores_fitted", _two_step_sql("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, seconds, round((z - mean) / sd, 9) AS run_time FROM c1, m2
  WHERE l_orderkey % 2 = 0"""))
def time_scores_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """New rows scored with statistics that were fitted on the whole table and stored."""
    from raceform.session import materialize

    rows = _seconds(spark, sf)
    fitted = materialize(stats.time_scores(rows, "seconds", "run_time")[1], "time_table")
    new = rows.where(F.col("l_orderkey") % 2 == 0)
    return stats.apply_time_scores(new, "seconds", fitted, "run_time").withColumn("run_time", F.round("run_time", 9))


@query("A13_tier_statistics", """SELECT l_suppkey AS jockey_id, round(sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100 / count(*), 3) AS mean_tier1,
    max(l_extendedprice) AS max_tier1, min(l_extendedprice) AS min_tier1,
    round(sum(CAST(round(l_quantity * 100) AS BIGINT))::DOUBLE / 100 / count(*), 3) AS mean_tier2, max(l_quantity) AS max_tier2, min(l_quantity) AS min_tier2
  FROM lineitem WHERE l_linenumber < 4 GROUP BY 1""")
def tier_statistics(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("jockey_id"), F.col("l_linenumber").alias("rank"),
        F.col("l_extendedprice").alias("tier1"), F.col("l_quantity").alias("tier2"))
    return stats.tier_statistics(li, "jockey_id", "rank", ["tier1", "tier2"])


@query("A14_row_sums", f"""WITH {roles.RIDES} SELECT jockey_id, CAST(year AS VARCHAR) AS year_text, count(*)::BIGINT AS starts,
  count(*) FILTER (horse_number <= 3)::BIGINT AS top3 FROM rides GROUP BY ALL""")
def row_sums(spark: SparkSession, sf: str) -> DataFrame:
    totals = roles.jockey_totals(spark, sf).where(F.col("year_text") != "累計")
    c = F.col
    return totals.select("jockey_id", "year_text", row_sum(c("first"), c("second"), c("third"), c("other")).alias("starts"),
                         row_sum(c("first"), c("second"), c("third")).alias("top3"))


@query("A15_row_means", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS load_mean
  FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 3 = 0 THEN l_extendedprice END AS b,
    CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS DOUBLE) END AS c FROM lineitem) q""")
def row_means(spark: SparkSession, sf: str) -> DataFrame:
    values = F.array(
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity")), F.when(F.col("l_partkey") % 3 == 0, F.col("l_extendedprice")),
        F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("double")))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", tx.row_mean(values).alias("load_mean"))


@query("A16_distinct_values", "SELECT DISTINCT o_custkey AS horse_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("horse_id"), iso("o_orderdate").alias("day")).distinct()


@query("A17_drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def drop_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").dropDuplicates()


@query("A18_row_count", "SELECT count(*)::BIGINT AS row_count FROM lineitem")
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_rows(t(spark, sf, "lineitem"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_quantity") / 50
    return t(spark, sf, "lineitem").select((F.col("l_linenumber") < 4).cast("int").alias("y"), p.alias("p"))


@query("A19_confusion", """SELECT count(*)::BIGINT AS total, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, tp / total::DOUBLE * 100 AS tp_pct, fp / total::DOUBLE * 100 AS fp_pct,
    tn / total::DOUBLE * 100 AS tn_pct, fn / total::DOUBLE * 100 AS fn_pct
  FROM (SELECT count(*) AS total, count(*) FILTER (l_linenumber < 4 AND l_quantity / 50 >= 0.5) AS tp, count(*) FILTER (l_linenumber >= 4 AND l_quantity / 50 >= 0.5) AS fp,
    count(*) FILTER (l_linenumber >= 4 AND l_quantity / 50 < 0.5) AS tn, count(*) FILTER (l_linenumber < 4 AND l_quantity / 50 < 0.5) AS fn FROM lineitem) q""".replace("count(*)::BIGINT AS total", "total::BIGINT AS total", 1))
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return stats.confusion(_predictions(spark, sf), "y", "p")


@query("A20_roc_auc", """SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc
  FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r
    FROM (SELECT CASE WHEN l_linenumber < 4 THEN 1 ELSE 0 END AS y, l_extendedprice / 200000 AS p FROM lineitem) a) b""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "lineitem").select((F.col("l_linenumber") < 4).cast("int").alias("y"), (F.col("l_extendedprice") / 200000).alias("p"))
    return stats.roc_auc(p, "y", "p")


@query("M3_class_weights", """SELECT y, sum(n) OVER ()::DOUBLE / (2 * n) AS weight FROM (SELECT CASE WHEN l_linenumber < 4 THEN 1 ELSE 0 END AS y, count(*) AS n FROM lineitem GROUP BY 1) q""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_weights(_predictions(spark, sf), "y")


@query("M7_evaluation", """SELECT auc, tp_pct, fp_pct, tn_pct, fn_pct FROM (
  SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc,
    count(*) FILTER (y = 1 AND p >= 0.5) / count(*)::DOUBLE * 100 AS tp_pct, count(*) FILTER (y = 0 AND p >= 0.5) / count(*)::DOUBLE * 100 AS fp_pct,
    count(*) FILTER (y = 0 AND p < 0.5) / count(*)::DOUBLE * 100 AS tn_pct, count(*) FILTER (y = 1 AND p < 0.5) / count(*)::DOUBLE * 100 AS fn_pct
  FROM (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r
    FROM (SELECT CASE WHEN l_linenumber < 4 THEN 1 ELSE 0 END AS y, l_quantity / 50 AS p FROM lineitem) a) b) c""")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    p = _predictions(spark, sf)
    cells = stats.confusion(p, "y", "p").select("tp_pct", "fp_pct", "tn_pct", "fn_pct")
    return cells.withColumn("auc", stats.roc_auc(p, "y", "p").scalar())
