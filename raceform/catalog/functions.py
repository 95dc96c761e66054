"""Scalar functions on texts and numbers derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog import roles
from raceform.catalog.registry import query
from raceform.catalog.roles import iso, pick, sql_list, t
from raceform.functions import codes, numeric
from raceform.functions import text as tx
from raceform.operators.pages import recognise_header
from raceform.operators.project import sentinels_to_null

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
_LINE_SQL = ", ".join(_LINE)


def _lines(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return t(spark, sf, "lineitem").select(*_LINE, *[c.alias(n) for n, c in columns.items()])


def _contains_sql(text: str, rules: list, default: object) -> str:
    whens = []
    for keys, value in rules:
        keys = [keys] if isinstance(keys, str) else keys
        test = " OR ".join(f"contains({text}, '{k}')" for k in keys)
        whens.append(f"WHEN {test} THEN {value!r}")
    return f"CASE {' '.join(whens)} ELSE {default!r} END"


_CLASS = f"concat(({sql_list(roles.CLASS_TEXTS)})[p_size % 15 + 1], ' ', p_name)"


def _class_text(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    return p.select("p_partkey", F.concat(pick(roles.CLASS_TEXTS, F.col("p_size") % 15), F.lit(" "), F.col("p_name")).alias("class"))


@query("F1_grade", f"SELECT p_partkey, {_contains_sql(_CLASS, codes.GRADE_RULES, 0)} AS grade FROM part")
def grade(spark: SparkSession, sf: str) -> DataFrame:
    return _class_text(spark, sf).select("p_partkey", codes.grade(F.col("class")).alias("grade"))


@query("F2_class_label", f"SELECT p_partkey, {_contains_sql(_CLASS, codes.CLASS_LABEL_RULES, codes.UNKNOWN_CLASS)} AS label FROM part")
def class_label(spark: SparkSession, sf: str) -> DataFrame:
    return _class_text(spark, sf).select("p_partkey", codes.class_label(F.col("class")).alias("label"))


def _map_sql(text: str, mapping: dict) -> str:
    return f"CASE {text} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


_TRAIN = ("gender", "turf_or_dirt", "lap", "racecourse", "weather")
_RAW_KEYS = "race_id, horse, horse_number, jockey, popularity"


@query("F3_training_codes", f"WITH {roles.RAW_RACE} SELECT {_RAW_KEYS}, {', '.join(f'{_map_sql(c, codes.TRAINING_CODES[c])} AS {c}' for c in _TRAIN)} FROM raw_race")
def training_codes(spark: SparkSession, sf: str) -> DataFrame:
    raw = roles.raw_race(spark, sf)
    return raw.select(*_RAW_KEYS.split(", "), *[codes.code(F.col(c), codes.TRAINING_CODES[c]).alias(c) for c in _TRAIN])


_WEATHERS = [*codes.CATEGORIES["weather"], "霧"]
_GOINGS = ["良", "重", "稍", "不", "稍重"]


@query("F4_scoring_codes", f"SELECT o_orderkey, {_map_sql(f'({sql_list(_WEATHERS)})[o_orderkey % 7 + 1]', codes.SCORING_CODES['weather'])} AS weather, {_map_sql(f'({sql_list(_GOINGS)})[o_orderkey % 5 + 1]', codes.SCORING_CODES['ground_state'])} AS ground_state FROM orders")
def scoring_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(
        "o_orderkey", codes.code(pick(_WEATHERS, k % 7), codes.SCORING_CODES["weather"]).alias("weather"),
        codes.code(pick(_GOINGS, k % 5), codes.SCORING_CODES["ground_state"]).alias("ground_state"))


@query("F5_fixed_category", f"""SELECT o_orderkey, CASE WHEN w IN ('{"', '".join(codes.CATEGORIES['weather'])}') THEN w END AS weather,
  CASE WHEN g IN ('{"', '".join(codes.CATEGORIES['ground_state'])}') THEN g END AS ground_state
  FROM (SELECT o_orderkey, ({sql_list(_WEATHERS)})[o_orderkey % 7 + 1] AS w, ({sql_list(_GOINGS)})[o_orderkey % 5 + 1] AS g FROM orders) q""")
def fixed_category(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(
        "o_orderkey", codes.fixed_category(pick(_WEATHERS, k % 7), codes.CATEGORIES["weather"]).alias("weather"),
        codes.fixed_category(pick(_GOINGS, k % 5), codes.CATEGORIES["ground_state"]).alias("ground_state"))


@query("F7_run_seconds", f"""SELECT {_LINE_SQL}, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE
  (60 + CAST(l_quantity AS INT) % 90) // 60 * 60.0::DOUBLE + (60 + CAST(l_quantity AS INT) % 90) % 60 + (l_suppkey % 10)::DOUBLE / 10 END AS seconds FROM lineitem""")
def run_seconds(spark: SparkSession, sf: str) -> DataFrame:
    total = F.lit(60) + F.col("l_quantity").cast("int") % 90
    text = F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"), F.lit("."),
                    (F.col("l_suppkey") % 10).cast("string"))
    return _lines(spark, sf, seconds=tx.run_seconds(F.when(F.col("l_partkey") % 50 == 0, "").otherwise(text)))


def _pass() -> Column:
    return F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 18).cast("string"))


@query("F9_pass_order_mean", f"SELECT {_LINE_SQL}, (l_linenumber + CAST(l_quantity AS INT) + l_suppkey % 18)::DOUBLE / 3 AS pass_order FROM lineitem")
def pass_order_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf, pass_order=tx.pass_order_mean(_pass()))


@query("F10_corners", f"SELECT {_LINE_SQL}, l_linenumber AS first_corner, CAST(l_suppkey % 18 AS INT) AS final_corner FROM lineitem")
def corners(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf, first_corner=tx.first_corner(_pass()), final_corner=tx.final_corner(_pass()))


@query("F11_corner_differences", f"""SELECT {_LINE_SQL}, CAST(l_suppkey % 18 - l_partkey % 18 AS BIGINT) AS final_to_rank, CAST(l_linenumber - l_partkey % 18 AS BIGINT) AS first_to_rank,
  CAST(l_suppkey % 18 - l_linenumber AS INT) AS first_to_final FROM lineitem""")
def corner_differences(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf, **numeric.corner_differences(tx.first_corner(_pass()), tx.final_corner(_pass()), F.col("l_partkey") % 18))


@query("F12_to_number", f"WITH {roles.RAW_RACE} SELECT {_RAW_KEYS}, TRY_CAST(odds AS DOUBLE) AS odds, TRY_CAST(rank AS INT) AS rank FROM raw_race")
def to_number(spark: SparkSession, sf: str) -> DataFrame:
    raw = sentinels_to_null(roles.raw_race(spark, sf).select(*_RAW_KEYS.split(", "), "odds", "rank"))
    return raw.withColumn("odds", tx.to_double(F.col("odds"))).withColumn("rank", tx.to_int(F.col("rank")))


@query("F13_race_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def race_date(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    japanese = F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    text = F.when(k % 11 == 0, "xx").when(k % 2 == 0, japanese).otherwise(F.date_format(d, "yyyy/MM/dd"))
    return t(spark, sf, "orders").select("o_orderkey", iso(tx.race_date(text)).alias("day"))


@query("F14_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day FROM orders")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in numeric.date_parts(F.col("o_orderdate")).items()])


@query("F15_day_ordinal", "SELECT o_orderkey, CAST((year(o_orderdate) - 2010) * 365 + month(o_orderdate) * 30 + day(o_orderdate) AS INT) AS ordinal FROM orders")
def day_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", numeric.day_ordinal(F.col("o_orderdate")).alias("ordinal"))


@query("F16_step_differences", f"""SELECT {_LINE_SQL}, l_quantity - l_linenumber AS distance_diff, CAST(l_linenumber - l_tax AS DOUBLE) AS distance_diff1,
  CAST(CAST(o_orderdate AS DATE) - CAST(l_shipdate AS DATE) AS DOUBLE) AS date_diff FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def step_differences(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"))
    li = t(spark, sf, "lineitem").withColumn("line", F.col("l_linenumber").cast("double")).withColumn("date1", F.col("l_shipdate"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    steps = {**numeric.step_differences(["l_quantity", "line", "l_tax"], "distance_diff"), **numeric.step_days(["date", "date1"], "date_diff")}
    return joined.select(*_LINE, *[c.alias(n) for n, c in steps.items()])


@query("F17_race_id_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS round_year, CAST(o_orderkey % 10 + 1 AS INT) AS course_id, CAST(o_orderkey % 7 + 1 AS INT) AS round_count,
  CAST(o_orderkey % 13 + 1 AS INT) AS round_day, CAST(o_orderkey % 12 + 1 AS INT) AS round FROM orders""")
def race_id_parts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [F.lpad((k % n + 1).cast("string"), 2, "0") for n in (10, 7, 13, 12)]
    race_id = F.concat(F.year("o_orderdate").cast("string"), *parts)
    return t(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in tx.race_id_parts(race_id).items()])


@query("F18_sex_age", "SELECT p_partkey, (['牡', '牝', 'セ'])[p_size % 3 + 1] AS sex, p_size AS age FROM part")
def sex_age(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(pick(["牡", "牝", "セ"], F.col("p_size") % 3), F.col("p_size").cast("string"))
    return t(spark, sf, "part").select("p_partkey", tx.sex(text).alias("sex"), tx.age(text).alias("age"))


@query("F19_body_weight", f"""SELECT {_LINE_SQL}, CASE l_partkey % 5 WHEN 0 THEN 0 ELSE CAST(l_partkey % 150 + 400 AS INT) END AS weight,
  CASE WHEN l_partkey % 5 < 2 THEN 0 ELSE CAST(l_suppkey % 21 - 10 AS INT) END AS weight_change,
  CASE l_partkey % 5 WHEN 0 THEN NULL ELSE CAST(l_partkey % 150 + 400 AS INT) END AS weight_or_null FROM lineitem""")
def body_weight(spark: SparkSession, sf: str) -> DataFrame:
    part, change = F.col("l_partkey"), F.col("l_suppkey") % 21 - 10
    weight = (part % 150 + 400).cast("string")
    signed = F.concat(F.when(change > 0, "+").otherwise(""), change.cast("string"))
    text = F.when(part % 5 == 0, "--").when(part % 5 == 1, F.concat(weight, F.lit("(前計不)"))).otherwise(F.concat(weight, F.lit("("), signed, F.lit(")")))
    return _lines(spark, sf, weight=tx.body_weight(text), weight_change=tx.body_weight_change(text), weight_or_null=tx.body_weight(text, "null"))


@query("F20_link_ids", """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS horse_id, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS jockey_id,
  CASE WHEN c_custkey % 2 = 0 THEN '栗東' ELSE '美浦' END AS stable FROM customer""")
def link_ids(spark: SparkSession, sf: str) -> DataFrame:
    horse = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    jockey = F.lpad(F.col("c_nationkey").cast("string"), 5, "0")
    stable = F.concat(F.when(F.col("c_custkey") % 2 == 0, "栗東").otherwise("美浦"), F.col("c_name"))
    return t(spark, sf, "customer").select(
        "c_custkey", tx.link_id(F.concat(F.lit("https://example.com/horse/"), horse), "horse").alias("horse_id"),
        tx.link_id(F.concat(F.lit("https://example.com/jockey/result/recent/"), jockey, F.lit("/")), "jockey").alias("jockey_id"),
        F.substring(stable, 1, 2).alias("stable"))


@query("F21_distance_bucket", """SELECT o_orderkey, CASE WHEN m < 1301 THEN 'S' WHEN m < 1900 THEN 'M' WHEN m < 2101 THEN 'I' WHEN m < 2701 THEN 'L' ELSE 'E' END AS bucket
  FROM (SELECT o_orderkey, o_orderkey % 2600 + 1000 AS m FROM orders) q""")
def distance_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", codes.distance_bucket(F.col("o_orderkey") % 2600 + 1000).alias("bucket"))


@query("F22_rest_weeks", """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 20 + 2 WHEN 1 THEN 1 ELSE 0 END AS INT) AS weeks FROM orders""")
def rest_weeks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    weeks = F.concat(F.lit("A 中"), (k % 20 + 2).cast("string"), F.lit("週 B"))
    text = F.when(k % 3 == 0, weeks).when(k % 3 == 1, "A 連闘 B").otherwise(F.col("o_orderpriority"))
    return t(spark, sf, "orders").select("o_orderkey", tx.rest_weeks(text).alias("weeks"))


_CHAIN = """SELECT race_id, horse_number, horse_id, jockey_id, quantity, top3, top2, round_even(top3 * top2 * win_raw, 3) AS win
  FROM (SELECT *, round_even(top3_raw, 3) AS top3, round_even(round_even(top3_raw, 3) * top2_raw, 3) AS top2 FROM scores) q"""
_SCORE_KEYS = ("race_id", "horse_number", "horse_id", "jockey_id", "quantity")


def _chained(spark: SparkSession, sf: str) -> DataFrame:
    c = numeric.chained_probabilities(F.col("top3_raw"), F.col("top2_raw"), F.col("win_raw"))
    return roles.scores(spark, sf).select(*_SCORE_KEYS, *[x.alias(n) for n, x in c.items()])


@query("F23_chained_probabilities", f"WITH {roles.SCORES} {_CHAIN}")
def chained_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf)


@query("F24_implied_odds", f"""WITH {roles.SCORES}, c AS ({_CHAIN}) SELECT race_id, horse_number, horse_id, jockey_id, quantity,
  CASE WHEN win = 0 THEN 'Infinity'::DOUBLE ELSE round_even(1 / win * 0.8::DOUBLE, 3) END AS odds_implied FROM c""")
def implied_odds(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf).select(*_SCORE_KEYS, numeric.implied_odds(F.col("win")).alias("odds_implied"))


@query("F25_expected_place", f"""WITH {roles.SCORES} SELECT race_id, horse_number, horse_id, jockey_id, quantity, round_even(p1 + p2 * 2 + p3 * 3, 3) AS expected3,
  round_even(p1 + p2 * 2 + p3 * 3 + p_other * 4, 3) AS expected4 FROM scores""")
def expected_place(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return roles.scores(spark, sf).select(
        *_SCORE_KEYS, numeric.expected_place(c("p1"), c("p2"), c("p3")).alias("expected3"),
        numeric.expected_place(c("p1"), c("p2"), c("p3"), c("p_other")).alias("expected4"))


@query("F26_placed_label", f"WITH {roles.RAW_RACE} SELECT {_RAW_KEYS}, CASE WHEN r IS NOT NULL THEN CASE WHEN r < 4 THEN 1 ELSE 0 END END AS label FROM (SELECT *, TRY_CAST(rank AS INT) AS r FROM raw_race) q WHERE r IS NOT NULL")
def placed_label(spark: SparkSession, sf: str) -> DataFrame:
    from raceform.operators.ml import placed_label as label

    raw = roles.raw_race(spark, sf).withColumn("rank", tx.to_int(F.col("rank"))).na.drop(subset=["rank"])
    return raw.select(*_RAW_KEYS.split(", "), label(F.col("rank")).alias("label"))


@query("F27_composite_key", "SELECT o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%d'), o_custkey) AS key FROM orders")
def composite_key(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", tx.composite_key(iso("o_orderdate"), F.col("o_custkey")).alias("key"))


@query("F28_casts", f"SELECT {_LINE_SQL}, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_suppkey AS VARCHAR) AS text FROM lineitem")
def casts(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf, whole=F.col("l_extendedprice").cast("bigint"), text=F.col("l_suppkey").cast("string"))


@query("F29_header_recognition", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '芝' WHEN o_orderkey % 3 = 1 THEN 'ダート' ELSE '障害' END AS race_type,
  CAST(o_orderkey % 20 * 100 + 1000 AS INT) AS course_len, ({sql_list(codes.GROUND_STATES)})[o_orderkey % 6 + 1] AS ground_state,
  ({sql_list(codes.HEADER_WEATHER)})[o_orderkey % 6 + 1] AS weather, (['右', '左', '直線'])[o_orderkey % 3 + 1] AS course_type,
  concat(year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日') AS date FROM orders""")
def header_recognition(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    metres = (k % 20 * 100 + 1000).cast("string")
    texts = F.array(
        F.concat(pick(["芝", "ダ", "障"], k % 3), metres, F.lit("m")), F.concat(F.lit("("), pick(["右", "左", "直線"], k % 3), F.lit(")")),
        pick(codes.GROUND_STATES, k % 6), pick(codes.HEADER_WEATHER, k % 6),
        F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日")))
    return t(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in recognise_header(texts).items()])
