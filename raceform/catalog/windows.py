"""Lags, fills, last-N, splits and deviation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog import roles
from raceform.catalog.registry import query
from raceform.catalog.roles import iso, t
from raceform.functions.numeric import expected_place
from raceform.operators import deviation, ordered, stats
from raceform.operators.asof import FormSpec, form_features

_LAGGED = ("prize", "rank", "last3f")


def _lag_sql(unique: bool) -> str:
    source = "SELECT horse_id, date, max(prize) AS prize, max(rank) AS rank, max(last3f) AS last3f FROM runs GROUP BY ALL" if unique else "SELECT entry_id, horse_id, date, prize, rank, last3f FROM runs"
    over = "(PARTITION BY horse_id ORDER BY date DESC)" if unique else "(PARTITION BY horse_id ORDER BY date DESC, entry_id DESC)"
    lags = ", ".join(
        (f"strftime(lead(date, {i}) OVER {over}, '%Y-%m-%d') AS date{i}" if c == "date" else f"lead({c}, {i}) OVER {over} AS {c}{i}")
        for i in range(1, 6) for c in ("date", *_LAGGED))
    return f"WITH {roles.RUNS}, s AS ({source}) SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date), {lags} FROM s"


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[iso(c).alias(c) if c.startswith("date") else F.col(c) for c in df.columns])


@query("W1_lags", _lag_sql(False))
def lags(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf).select("entry_id", "horse_id", "date", *_LAGGED)
    return _dates_as_text(ordered.lag_features(r, "horse_id", "date", ["entry_id"], _LAGGED))


@query("W1_lags_one_per_day", _lag_sql(True))
def lags_one_per_day(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf).groupBy("horse_id", "date").agg(*[F.max(c).alias(c) for c in _LAGGED])
    return _dates_as_text(ordered.lag_features(r, "horse_id", "date", [], _LAGGED, one_per_day=True))


def _fill_sql(order: str) -> str:
    return f"""WITH {roles.RUNS} SELECT entry_id, horse_id,
      last_value(CASE WHEN rank > 3 THEN prize END IGNORE NULLS) OVER (PARTITION BY horse_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS prize FROM runs"""


@query("W2_forward_fill", _fill_sql("date, entry_id"))
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf).select("entry_id", "horse_id", "date", F.when(F.col("rank") > 3, F.col("prize")).alias("prize"))
    return ordered.forward_fill(r, "horse_id", "date", ["entry_id"], ["prize"]).drop("date")


@query("W2_forward_fill_newest_first", _fill_sql("date DESC, entry_id DESC"))
def forward_fill_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf).select("entry_id", "horse_id", "date", F.when(F.col("rank") > 3, F.col("prize")).alias("prize"))
    return ordered.forward_fill(r, "horse_id", "date", ["entry_id"], ["prize"], newest_first=True).drop("date")


@query("W3_forward_fill_all", f"""WITH {roles.RUNS} SELECT entry_id, last_value(CASE WHEN rank = 1 THEN prize END IGNORE NULLS)
  OVER (ORDER BY date, entry_id ROWS UNBOUNDED PRECEDING) AS prize FROM runs""")
def forward_fill_all(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf).select("entry_id", "date", F.when(F.col("rank") == 1, F.col("prize")).alias("prize"))
    return ordered.forward_fill_all(r, ["date", "entry_id"], ["prize"]).drop("date")


@query("W4_last_n", f"""WITH {roles.RUNS} SELECT entry_id, horse_id, prize FROM runs
  QUALIFY row_number() OVER (PARTITION BY horse_id ORDER BY date DESC, entry_id DESC) <= 3""")
def last_n(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf).select("entry_id", "horse_id", "date", "prize")
    return ordered.last_n(r, ["horse_id"], ["date", "entry_id"], 3).drop("date")


# Deviation scores --------------------------------------------------------------------

_KEYS = "race_id, horse_number, horse_id, jockey_id, quantity"
_OFFSETS = {"p1": 60, "p2": 25, "p3": 15, "p_other": 0, "top3": 60, "expected": 50}


def _unit_sql(c: str) -> str:
    return f"CAST(round({c} * 1000) AS BIGINT)"


def _sums_sql(columns: tuple[str, ...]) -> str:
    return ", ".join(f"count({c}) AS n_{c}, sum({_unit_sql(c)}) AS s_{c}, sum({_unit_sql(c)} * {_unit_sql(c)}) AS q_{c}" for c in columns)


def _score_sql(c: str, name: str) -> str:
    n, s, q = f"n_{c}::DOUBLE", f"s_{c}::DOUBLE", f"q_{c}::DOUBLE"
    sd = f"(sqrt(greatest({q} - {s} * {s} / {n}, 0) / ({n} - 1)) / 1000)"
    sign = "-" if c == "expected" else ""
    return f"CASE WHEN n_{c} > 1 AND {sd} > 0 THEN round_even({sign}(({c} - {s} / 1000 / {n}) / {sd} * 10) + {_OFFSETS[c]}, 3) + 0.0::DOUBLE END AS {name}"


_EXPECTED = "round_even(p1 + p2 * 2 + p3 * 3 + p_other * 4, 3)"


def _history_sql(*groups: str) -> str:
    by = ", ".join(groups)
    same = lambda a, b: " AND ".join(f"{a}.{g} = {b}.{g}" for g in groups)
    of = lambda a: ", ".join(f"{a}.{g}" for g in groups)
    cols = ("p1", "p2", "p3", "p_other", "expected")
    prefix = f"dev_{'_'.join(groups)}_"
    merged = ", ".join(f"own.{k}_{c} + coalesce(h.{k}_{c}, 0) AS {k}_{c}" for c in cols for k in "nsq")
    hist = ", ".join(f"sum(d.{k}_{c}) AS {k}_{c}" for c in cols for k in "nsq")
    names = ", ".join(_score_sql(c, prefix + c) for c in cols)
    return f"""WITH {roles.SCORES}, v AS (SELECT {_KEYS}, date, {by}, p1, p2, p3, p_other, {_EXPECTED} AS expected FROM scores),
      daily AS (SELECT {by}, date, {_sums_sql(cols)} FROM v GROUP BY ALL),
      own AS (SELECT race_id, {by}, date, {_sums_sql(cols)} FROM v GROUP BY ALL),
      h AS (SELECT {of("a")}, a.date, {hist} FROM (SELECT DISTINCT {by}, date FROM v) a JOIN daily d ON {same("d", "a")} AND d.date < a.date GROUP BY ALL),
      st AS (SELECT own.race_id, {merged} FROM own LEFT JOIN h ON {same("h", "own")} AND h.date = own.date)
      SELECT {_KEYS}, {names}, {prefix}p1 + {prefix}p2 + {prefix}p3 AS {prefix}sum FROM v JOIN st USING (race_id)"""


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return roles.scores(spark, sf).withColumn("expected", expected_place(c("p1"), c("p2"), c("p3"), c("p_other")))


def _history_scores(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    v = _valued(spark, sf).select(*_KEYS.split(", "), "date", *by, "p1", "p2", "p3", "p_other", "expected")
    return deviation.history_deviation(v, v, by).drop("date", *by, "p1", "p2", "p3", "p_other", "expected")


@query("W5_round_deviation", _history_sql("round"))
def round_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return _history_scores(spark, sf, "round")


@query("W6_class_deviation", _history_sql("class"))
def class_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return _history_scores(spark, sf, "class")


@query("W5_round_surface_deviation", _history_sql("round", "surface"))
def round_surface_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """Turf and dirt have histories of their own."""
    return _history_scores(spark, sf, "round", "surface")


@query("W6_class_surface_deviation", _history_sql("class", "surface"))
def class_surface_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return _history_scores(spark, sf, "class", "surface")


_RACE_COLS = ("p1", "p2", "p3", "top3", "expected")


@query("W7_race_deviation", f"""WITH {roles.SCORES}, v AS (SELECT {_KEYS}, p1, p2, p3, top3_raw AS top3, round_even(p1 + p2 * 2 + p3 * 3, 3) AS expected FROM scores),
  st AS (SELECT race_id, {_sums_sql(_RACE_COLS)} FROM v GROUP BY race_id)
  SELECT {_KEYS}, {', '.join(_score_sql(c, 'dev_' + c) for c in _RACE_COLS)}, round_even(dev_p1 + dev_p2 + dev_p3, 0) AS dev_sum FROM v JOIN st USING (race_id)""")
def race_deviation(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    v = roles.scores(spark, sf).select(
        *_KEYS.split(", "), "p1", "p2", "p3", c("top3_raw").alias("top3"), expected_place(c("p1"), c("p2"), c("p3")).alias("expected"))
    return deviation.race_deviation(v).drop(*_RACE_COLS)


@query("W8_rest_days", f"""WITH {roles.RUNS} SELECT e.entry_id, CAST(e.date - max(h.date) AS DOUBLE) AS rest_days FROM runs e
  LEFT JOIN runs h ON h.horse_id = e.horse_id AND h.date < e.date GROUP BY e.entry_id, e.date""")
def rest_days(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf).select("entry_id", "horse_id", "date")
    spec = FormSpec(metrics={}, windows=(), days_since="rest_days")
    return form_features(r, r, "horse_id", "date", ["entry_id"], spec).select("entry_id", "rest_days")


@query("W9_date_split", """WITH r AS (SELECT l_orderkey AS id, min(CAST(l_shipdate AS DATE)) AS day FROM lineitem GROUP BY 1),
  s AS (SELECT id, row_number() OVER (ORDER BY day, md5(CAST(id AS VARCHAR)), id) <= CAST(round_even(count(*) OVER () * 0.7::DOUBLE, 0) AS BIGINT) AS is_train FROM r)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, is_train FROM lineitem JOIN s ON id = l_orderkey""")
def date_split(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("day"))
    return ordered.split_by_date(li, "l_orderkey", "day").drop("day")


def _group_sql(ddof: int, expression: str) -> str:
    return f"""WITH {roles.SCORES}, st AS (SELECT jockey_id, {_sums_sql(('p3',))} FROM scores GROUP BY jockey_id),
      m AS (SELECT jockey_id, n_p3 AS n, s_p3::DOUBLE / 1000 / n_p3::DOUBLE AS mean, CASE WHEN n_p3 > {ddof} THEN
        sqrt(greatest(q_p3::DOUBLE - s_p3::DOUBLE * s_p3::DOUBLE / n_p3::DOUBLE, 0) / (n_p3::DOUBLE - {ddof})) / 1000 END AS sd FROM st)
      SELECT race_id, horse_number, horse_id, jockey_id, quantity, {expression} FROM scores JOIN m USING (jockey_id)"""


@query("W10_population_score", _group_sql(0, "CASE WHEN sd > 0 THEN CAST(trunc((p3 - mean) / sd * 10 + 50) AS BIGINT) END AS score"))
def population_score(spark: SparkSession, sf: str) -> DataFrame:
    s = roles.scores(spark, sf).select(*_KEYS.split(", "), "p3")
    return deviation.population_score(s, "p3", ["jockey_id"], "score").drop("p3")


@query("W11_sample_scale", _group_sql(1, "CASE WHEN sd = 0 THEN 0 ELSE (p3 - mean) / sd END AS scaled"))
def sample_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = roles.scores(spark, sf).select(*_KEYS.split(", "), "p3")
    return deviation.sample_scale(s, "p3", ["jockey_id"], "scaled").drop("p3")


@query("W12_standardise", _group_sql(0, "CASE WHEN sd > 0 THEN (p3 - mean) / sd END AS std_p3"))
def standardise(spark: SparkSession, sf: str) -> DataFrame:
    s = roles.scores(spark, sf).select(*_KEYS.split(", "), "p3")
    return stats.standardise(s, {"p3": 3}, ["jockey_id"])


@query("W13_renumber", """SELECT l_orderkey AS race_id, l_linenumber, l_partkey, l_suppkey, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem""")
def renumber(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ordered.number_rows(li, ["race_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "n")


# Sorts and first rows ----------------------------------------------------------------

@query("O2_presentation_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC")
def presentation_order(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey"))


@query("O3_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("O4_first_per_group", f"""WITH {roles.RUNS} SELECT horse_id, entry_id, prize FROM runs
  QUALIFY row_number() OVER (PARTITION BY horse_id ORDER BY date DESC, entry_id DESC) = 1""")
def first_per_group(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.runs(spark, sf)
    return r.groupBy("horse_id").agg(F.max_by(F.struct("entry_id", "prize"), F.struct("date", "entry_id")).alias("r")).select("horse_id", "r.*")
