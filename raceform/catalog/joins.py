"""Joins, including the point-in-time ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog import roles
from raceform.catalog.registry import query
from raceform.catalog.roles import iso, t
from raceform.operators import joins, reshape
from raceform.operators.asof import ALL, FormSpec, form_features, jockey_form, jockey_year_wide, rolling_form
from raceform.operators.ordered import latest_values
from raceform.operators.stats import with_win_rate, with_win_rate_before
from raceform.plans.form import HORSE_METRICS, JOCKEY_PAIRS, jockey_years


@query("J1_not_collected", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def not_collected(spark: SparkSession, sf: str) -> DataFrame:
    seen = t(spark, sf, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_collected(t(spark, sf, "customer").select("c_custkey", "c_name"), seen, "c_custkey")


@query("J2_race_info", """SELECT l_orderkey AS race_id, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderstatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def race_info(spark: SparkSession, sf: str) -> DataFrame:
    entries = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("race_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    info = t(spark, sf, "orders").select(F.col("o_orderkey").alias("race_id"), "o_orderstatus")
    return joins.with_race_info(entries, info)


# Point-in-time horse form ------------------------------------------------------------

METRICS = HORSE_METRICS
SPEC = FormSpec(metrics=METRICS, avg=tuple(METRICS), std=("rank", "prize", "last3f"), max=("prize",), total=("prize",), days_since="rest_days")


def _stat_sql(m: str, d: int, n: int | str, spec: FormSpec, row: str = "rn") -> list[str]:
    """Statistics of one metric over the newest n joined rows, from whole units."""
    u = f"CAST(round({m} * {10**d}) AS BIGINT)" if d else f"CAST({m} AS BIGINT)"
    f = "" if n == ALL else f" FILTER ({row} <= {n})"
    s, k, q = f"sum({u}){f}::DOUBLE", f"count({u}){f}::DOUBLE", f"sum({u}::HUGEINT * {u}){f}::DOUBLE"
    unit = f"{10**d}.0::DOUBLE"
    mean = f"{s} / ({unit}) / {k}" if d else f"{s} / {k}"
    out = []
    if m in spec.avg:
        out.append(f"{mean} AS avg_{m}_{n}")
    if m in spec.std:
        out.append(f"CASE WHEN {k} > 1 THEN sqrt(greatest({q} - {s} * {s} / {k}, 0) / ({k} - 1)) / ({unit}) END AS std_{m}_{n}")
    if m in spec.max:
        out.append(f"max({u}){f}::DOUBLE / ({unit}) AS max_{m}_{n}")
    if m in spec.total:
        out.append(f"{s} / ({unit}) AS total_{m}_{n}")
    return out


def _form_sql(spec: FormSpec) -> str:
    stats = [x for n in spec.windows for m, d in spec.metrics.items() for x in _stat_sql(m, d, n, spec)]
    nl = ",\n    "
    return f"""WITH {roles.RUNS}, past AS (SELECT e.entry_id AS id, e.date AS day, h.*,
    row_number() OVER (PARTITION BY e.entry_id ORDER BY h.date DESC, h.entry_id DESC) AS rn
    FROM runs e JOIN runs h ON e.horse_id = h.horse_id AND h.date < e.date),
  form AS (SELECT id, {nl.join(stats)}, CAST(max(day) - max(date) AS DOUBLE) AS rest_days FROM past GROUP BY id)
  SELECT e.entry_id, e.horse_id, strftime(e.date, '%Y-%m-%d') AS date, form.* EXCLUDE (id) FROM runs e LEFT JOIN form ON id = e.entry_id"""


@query("J3_asof_form", _form_sql(SPEC))
def asof_form(spark: SparkSession, sf: str) -> DataFrame:
    history = roles.runs(spark, sf)
    entries = history.select("entry_id", "horse_id", "date")
    return form_features(entries, history, "horse_id", "date", ["entry_id"], SPEC).withColumn("date", iso("date"))


ROLLING = FormSpec(metrics={"prize": 2}, avg=("prize",), std=("prize",), max=("prize",), total=("prize",), days_since="rest_days")


def _rolling_sql() -> str:
    stats = [x for n in ROLLING.windows for x in _stat_sql("prize", 2, n, ROLLING)]
    return f"""WITH days AS (SELECT o_custkey AS horse_id, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS prize FROM orders GROUP BY ALL),
  past AS (SELECT e.horse_id, e.date AS day, h.date, h.prize, row_number() OVER (PARTITION BY e.horse_id, e.date ORDER BY h.date DESC) AS rn
    FROM days e JOIN days h ON e.horse_id = h.horse_id AND h.date < e.date),
  form AS (SELECT horse_id, day, {', '.join(stats)}, CAST(max(day) - max(date) AS DOUBLE) AS rest_days FROM past GROUP BY horse_id, day)
  SELECT e.horse_id, strftime(e.date, '%Y-%m-%d') AS date, e.prize, form.* EXCLUDE (horse_id, day)
  FROM days e LEFT JOIN form ON form.horse_id = e.horse_id AND form.day = e.date"""


@query("J3b_rolling_form", _rolling_sql())
def rolling(spark: SparkSession, sf: str) -> DataFrame:
    days = roles.runs(spark, sf).groupBy("horse_id", "date").agg(F.max("prize").alias("prize"))
    return rolling_form(days, "horse_id", "date", ROLLING).withColumn("date", iso("date"))


@query("J4_form_of_other_table", f"""WITH {roles.RUNS}, asked AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_partkey AS horse_id, CAST(l_shipdate AS DATE) AS date FROM lineitem),
  days AS (SELECT DISTINCT horse_id, date FROM asked),
  past AS (SELECT d.horse_id, d.date AS day, h.* EXCLUDE (horse_id), row_number() OVER (PARTITION BY d.horse_id, d.date ORDER BY h.date DESC, h.entry_id DESC) AS rn
    FROM days d JOIN runs h ON d.horse_id = h.horse_id AND h.date < d.date),
  form AS (SELECT horse_id, day, {', '.join(_stat_sql('prize', 2, 3, ROLLING) + _stat_sql('prize', 2, ALL, ROLLING))} FROM past GROUP BY ALL)
  SELECT a.* EXCLUDE (date), strftime(a.date, '%Y-%m-%d') AS date, form.* EXCLUDE (horse_id, day)
  FROM asked a LEFT JOIN form ON form.horse_id = a.horse_id AND form.day = a.date""")
def form_of_other_table(spark: SparkSession, sf: str) -> DataFrame:
    asked = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.col("l_partkey").alias("horse_id"), F.to_date("l_shipdate").alias("date"),
    )
    spec = FormSpec(metrics={"prize": 2}, windows=(3, ALL), avg=("prize",), std=("prize",), max=("prize",), total=("prize",))
    formed = form_features(asked, roles.runs(spark, sf), "horse_id", "date", ["entry_id"], spec)
    return formed.withColumn("date", iso("date"))


@query("J5_last_known_sires", """WITH h AS (SELECT o_custkey AS horse_id, o_orderdate, o_orderkey, nullif(o_orderstatus, 'P') AS sire_id,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS dam_sire_id FROM orders),
  last AS (SELECT horse_id, arg_max(sire_id, (o_orderdate, o_orderkey)) FILTER (sire_id IS NOT NULL) AS sire_id,
    arg_max(dam_sire_id, (o_orderdate, o_orderkey)) FILTER (dam_sire_id IS NOT NULL) AS dam_sire_id FROM h GROUP BY horse_id)
  SELECT c_custkey AS horse_id, c_name, sire_id, dam_sire_id FROM customer LEFT JOIN last ON horse_id = c_custkey""")
def last_known_sires(spark: SparkSession, sf: str) -> DataFrame:
    history = t(spark, sf, "orders").select(
        F.col("o_custkey").alias("horse_id"), "o_orderdate", "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("sire_id"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("dam_sire_id"),
    )
    last = latest_values(history, ["horse_id"], ["o_orderdate", "o_orderkey"], ["sire_id", "dam_sire_id"])
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("horse_id"), "c_name").join(last, "horse_id", "left")


# Year-granular jockey form -----------------------------------------------------------

CATEGORY_PAIRS = {f"{c}_win_rate": (f"{c}_wins", f"{c}_starts") for c in ("graded", "special", "regular", "turf", "dirt")}


def _category_sql() -> str:
    rates = ",\n".join(
        f"sum(wins) FILTER (category = '{c}')::DOUBLE / nullif(sum(starts) FILTER (category = '{c}'), 0)::DOUBLE AS {c}_win_rate"
        for c in ("graded", "special", "regular", "turf", "dirt"))
    return f"""WITH {roles.RIDES}, long AS (SELECT jockey_id, year, category, count(*) AS starts, count(*) FILTER (l_discount >= 0.05) AS wins
      FROM (SELECT jockey_id, year, l_discount, kind AS category FROM rides UNION ALL SELECT jockey_id, year, l_discount, surface FROM rides) c GROUP BY ALL),
    asked AS (SELECT DISTINCT jockey_id, year FROM rides),
    last2 AS (SELECT a.jockey_id, a.year AS asked_year, l.year FROM asked a JOIN (SELECT DISTINCT jockey_id, year FROM long) l
      ON l.jockey_id = a.jockey_id AND l.year < a.year QUALIFY row_number() OVER (PARTITION BY a.jockey_id, a.year ORDER BY l.year DESC) <= 2),
    rates AS (SELECT jockey_id, asked_year, {rates} FROM last2 JOIN long USING (jockey_id, year) GROUP BY ALL)
    SELECT r.race_id, r.horse_number, r.horse_id, r.l_quantity, r.jockey_id, r.year, rates.* EXCLUDE (jockey_id, asked_year)
    FROM rides r LEFT JOIN rates ON rates.jockey_id = r.jockey_id AND rates.asked_year = r.year"""


@query("J6_jockey_category_rates", _category_sql())
def jockey_category_rates(spark: SparkSession, sf: str) -> DataFrame:
    yearly = jockey_year_wide(roles.jockey_long(spark, sf))
    entries = roles.rides(spark, sf).select("race_id", "horse_number", "horse_id", "l_quantity", "jockey_id", "year")
    return jockey_form(entries, yearly, CATEGORY_PAIRS)


@query("J7_jockey_overall_rates", f"""WITH {roles.RIDES}, yearly AS (SELECT jockey_id, year, count(*) AS starts, count(*) FILTER (horse_number = 1) AS wins,
    count(*) FILTER (horse_number <= 3) AS top3 FROM rides GROUP BY ALL),
  asked AS (SELECT DISTINCT jockey_id, year FROM rides),
  last2 AS (SELECT a.jockey_id, a.year AS asked_year, y.starts, y.wins, y.top3 FROM asked a JOIN yearly y ON y.jockey_id = a.jockey_id AND y.year < a.year
    QUALIFY row_number() OVER (PARTITION BY a.jockey_id, a.year ORDER BY y.year DESC) <= 2),
  rates AS (SELECT jockey_id, asked_year, sum(wins)::DOUBLE / sum(starts)::DOUBLE AS win_rate, sum(top3)::DOUBLE / sum(starts)::DOUBLE AS top3_rate FROM last2 GROUP BY ALL)
  SELECT r.race_id, r.horse_number, r.horse_id, r.l_quantity, r.jockey_id, r.year, win_rate, top3_rate
  FROM rides r LEFT JOIN rates ON rates.jockey_id = r.jockey_id AND rates.asked_year = r.year""")
def jockey_overall_rates(spark: SparkSession, sf: str) -> DataFrame:
    yearly = jockey_years(roles.jockey_totals(spark, sf))
    entries = roles.rides(spark, sf).select("race_id", "horse_number", "horse_id", "l_quantity", "jockey_id", "year")
    return jockey_form(entries, yearly, {k: JOCKEY_PAIRS[k] for k in ("win_rate", "top3_rate")})


# Role and lookup joins ---------------------------------------------------------------

@query("J8_sire_roles", """SELECT c.c_custkey AS horse_id, f.c_acctbal AS f_c_acctbal, f.c_nationkey AS f_c_nationkey, ff.c_acctbal AS ff_c_acctbal,
    ff.c_nationkey AS ff_c_nationkey, mf.c_acctbal AS mf_c_acctbal, mf.c_nationkey AS mf_c_nationkey
  FROM (SELECT *, (c_custkey * 31 + 7) % n AS s, (c_custkey * 17 + 3) % (n + n // 15) AS ss, (c_custkey * 13 + 5) % n AS ds FROM customer, (SELECT count(*) AS n FROM customer) z) c
  LEFT JOIN customer f ON f.c_custkey = s LEFT JOIN customer ff ON ff.c_custkey = ss LEFT JOIN customer mf ON mf.c_custkey = ds""")
def sire_roles(spark: SparkSession, sf: str) -> DataFrame:
    c, k = t(spark, sf, "customer"), F.col("c_custkey")
    # Any customer can be a sire; some sires of sires are unknown.
    n = c.agg(F.count(F.lit(1)).alias("n")).scalar()
    entries = c.select(k.alias("horse_id"), ((k * 31 + 7) % n).alias("sire_id"), ((k * 17 + 3) % (n + F.floor(n / 15))).alias("sire_sire_id"),
                       ((k * 13 + 5) % n).alias("dam_sire_id"))
    stats = c.select("c_custkey", "c_acctbal", "c_nationkey")
    out = joins.attach_roles(entries, stats, "c_custkey", {"f_": "sire_id", "ff_": "sire_sire_id", "mf_": "dam_sire_id"})
    return out.drop("sire_id", "sire_sire_id", "dam_sire_id")


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Pedigree tree rows: 32 per customer, ancestor names by generation and node."""
    k, r = F.col("c_custkey"), F.col("row")
    names = [
        F.concat(F.lit(f"A{g}_"), ((k * 31 + g * 7 + F.floor(r / 2 ** (4 - g)) * 3) % 97).cast("string")).alias(f"g{g}")
        for g in range(reshape.GENERATIONS)
    ]
    rows = t(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("row"))
    return rows.select(k.alias("horse_id"), "row", *names)


def _ancestor_sql(pos: str) -> str:
    """Ancestor at a position: generation g starts at position 2^(g+1) - 2."""
    g = f"CAST(floor(log2({pos} + 2)) AS BIGINT) - 1"
    return f"concat('A', {g}, '_', (c_custkey * 31 + ({g}) * 7 + ({pos} + 2 - CAST(pow(2, {g} + 1) AS BIGINT)) * 3) % 97)"


@query("J9_coded_pedigree", """SELECT o_orderkey, o_custkey AS horse_id, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS peds_code
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def coded_pedigree(spark: SparkSession, sf: str) -> DataFrame:
    codes = t(spark, sf, "customer").where(F.col("c_custkey") % 4 > 0).select(
        F.col("c_custkey").alias("horse_id"), F.col("c_nationkey").alias("peds_code"))
    entries = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("horse_id"))
    return joins.attach_by_key(entries, codes, ["horse_id"], ["peds_code"])


@query("J10_flat_pedigree", f"""SELECT o_orderkey, o_custkey AS horse_id, {', '.join(f"{_ancestor_sql(str(p))} AS peds_{p}" for p in range(62))}
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def flat_pedigree(spark: SparkSession, sf: str) -> DataFrame:
    long = reshape.flatten_pedigree(_tree(spark, sf), "horse_id", "row", [f"g{g}" for g in range(5)])
    entries = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("horse_id"))
    return reshape.attach_pedigree(entries, long, "horse_id")


@query("X4_flatten_pedigree", f"""SELECT c_custkey AS horse_id, CAST(pos AS INT) AS pos, {_ancestor_sql('pos')} AS ancestor
  FROM customer, range(62) p(pos)""")
def flatten_pedigree(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.flatten_pedigree(_tree(spark, sf), "horse_id", "row", [f"g{g}" for g in range(5)])


@query("J11_jockey_rate_on_rows", f"""WITH {roles.RIDES} SELECT race_id, horse_number, horse_id, l_quantity, jockey_id,
  count(*) FILTER (horse_number = 1) OVER (PARTITION BY jockey_id)::DOUBLE / count(*) OVER (PARTITION BY jockey_id) AS jockey_win_rate FROM rides""")
def jockey_rate_on_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.rides(spark, sf).select("race_id", "horse_number", "horse_id", "l_quantity", "jockey_id")
    return with_win_rate(r, "jockey_id", "horse_number")


@query("J11_jockey_rate_before", f"""WITH {roles.SCORES} SELECT race_id, horse_number, horse_id, quantity, jockey_id,
  count(*) FILTER (horse_number = 1) OVER w::DOUBLE / nullif(count(*) OVER w, 0) AS jockey_win_rate FROM scores
  WINDOW w AS (PARTITION BY jockey_id ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def jockey_rate_before(spark: SparkSession, sf: str) -> DataFrame:
    r = roles.scores(spark, sf).select("race_id", "horse_number", "horse_id", "quantity", "jockey_id", "date")
    return with_win_rate_before(r, "jockey_id", "date", "horse_number").drop("date")


@query("J12_lookup_last", """SELECT o_orderkey, orders.o_custkey, coalesce(score, 50.0::DOUBLE) AS score FROM orders LEFT JOIN (
    SELECT l_partkey AS o_custkey, year(l_shipdate) AS y, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS score
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) p ON p.o_custkey = orders.o_custkey AND p.y = year(o_orderdate)""")
def lookup_last(spark: SparkSession, sf: str) -> DataFrame:
    past = t(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("o_custkey"), F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("score"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
    )
    now = t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    return joins.lookup_last(now, past, ["o_custkey", "y"], "score", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]).drop("y")


@query("J13_label_lookups", """SELECT o_orderkey, r.label AS o_orderpriority_label, s.label AS o_orderstatus_label FROM orders
  LEFT JOIN (SELECT o_orderpriority AS p, count(*)::BIGINT AS label FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) r ON p = o_orderpriority
  LEFT JOIN (SELECT o_orderstatus AS st, count(*)::BIGINT AS label FROM orders GROUP BY 1) s ON st = o_orderstatus""")
def label_lookups(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    label = F.count(F.lit(1))
    tables = {
        "o_orderpriority": o.where(F.col("o_orderpriority") != "5-LOW").groupBy("o_orderpriority").agg(label.alias("o_orderpriority_label")),
        "o_orderstatus": o.groupBy("o_orderstatus").agg(label.alias("o_orderstatus_label")),
    }
    out = joins.label_lookups(o.select("o_orderkey", "o_orderpriority", "o_orderstatus"), tables)
    return out.drop("o_orderpriority", "o_orderstatus")


@query("J14_names_and_tiers", """SELECT s_suppkey AS jockey_id, s_name AS jockey_name, max_q, min_q FROM supplier JOIN (
  SELECT l_suppkey, max(l_quantity) AS max_q, min(l_quantity) AS min_q FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) q ON l_suppkey = s_suppkey""")
def names_and_tiers(spark: SparkSession, sf: str) -> DataFrame:
    from raceform.operators.stats import tier_statistics

    names = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("jockey_id"), F.col("s_name").alias("jockey_name"))
    li = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("jockey_id"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").alias("q"))
    return names.join(tier_statistics(li, "jockey_id", "rank", ["q"]), "jockey_id").drop("mean_q")


@query("J15_attach_by_key", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_type, p_size FROM lineitem
  LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""")
def attach_by_key(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    grades = t(spark, sf, "part").where(F.col("p_size") > 10).select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    return joins.attach_by_key(li, grades, ["l_partkey"], ["p_type", "p_size"])


@query("J16_impute_body_weight", """WITH e AS (SELECT l_orderkey AS race_id, l_linenumber AS horse_number, l_partkey AS horse_id, l_suppkey AS jockey_id, l_quantity AS quantity,
    CASE WHEN l_suppkey % 7 > 0 THEN concat(l_partkey % 150 + 400, '(', l_suppkey % 21 - 10, ')') END AS weight_text FROM lineitem),
  m AS (SELECT l_partkey AS horse_id, CAST(trunc(avg(l_partkey % 150 + 400 + l_linenumber)) AS BIGINT) AS w,
    CAST(trunc(sum(l_suppkey % 21 - 10)::DOUBLE / count(*)) AS BIGINT) AS c FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
  SELECT e.race_id, e.horse_number, e.horse_id, e.jockey_id, e.quantity,
    CASE WHEN bool_or(weight_text IS NULL) OVER (PARTITION BY race_id) THEN w || '(' || c || ')' ELSE weight_text END AS weight_text
  FROM e LEFT JOIN m USING (horse_id)""")
def impute_body_weight(spark: SparkSession, sf: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    li = t(spark, sf, "lineitem")
    text = F.concat((part % 150 + 400).cast("string"), F.lit("("), (supp % 21 - 10).cast("string"), F.lit(")"))
    entries = li.select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("horse_number"), part.alias("horse_id"),
        supp.alias("jockey_id"), F.col("l_quantity").alias("quantity"), F.when(supp % 7 > 0, text).alias("weight_text"),
    )
    history = li.where(F.col("l_returnflag") != "R").select(
        part.alias("horse_id"), (part % 150 + 400 + F.col("l_linenumber")).alias("weight"), (supp % 21 - 10).alias("weight_change"))
    return joins.impute_body_weight(entries, history, "race_id", "horse_id", "weight_text", "weight", "weight_change")
