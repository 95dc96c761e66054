"""Race roles of the driver tables, in Spark and as SQL text for the twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.sources.tables import driver_table as t

CLASS_TEXTS = [
    "3歳以上500万下", "1600万下", "オープン(L)", "2歳新馬", "3歳未勝利", "障害オープン", "天皇賞(G1)", "札幌記念(G2)",
    "府中牝馬S(G3)", "4歳以上１勝クラス", "3歳以上2勝クラス", "1000万下", "4歳以上3勝クラス", "オープン", "平場",
]


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def pick(values: list[str], index: Column) -> Column:
    """Item of a fixed list by a 0-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# One start of a horse: orders.
def runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    first, final = k % 18 + 1, k * 7 % 18 + 1
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return t(spark, sf, "orders").select(
        k.alias("entry_id"), F.col("o_custkey").alias("horse_id"), F.to_date("o_orderdate").alias("date"),
        rank.alias("rank"), F.col("o_totalprice").alias("prize"), ((k % 97) / 10 + 30).alias("last3f"),
        first.alias("first_corner"), final.alias("final_corner"), (final - rank).alias("final_to_rank"),
        (first - rank).alias("first_to_rank"), (final - first).alias("first_to_final"),
    )


RUNS = """runs AS (SELECT *, final_corner - rank AS final_to_rank, first_corner - rank AS first_to_rank,
  final_corner - first_corner AS first_to_final FROM (
  SELECT o_orderkey AS entry_id, o_custkey AS horse_id, CAST(o_orderdate AS DATE) AS date,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS rank, o_totalprice AS prize,
    CAST(o_orderkey % 97 AS DOUBLE) / 10 + 30 AS last3f, o_orderkey % 18 + 1 AS first_corner,
    o_orderkey * 7 % 18 + 1 AS final_corner FROM orders) q)"""


# One rider's line: lineitem.
def rides(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("horse_number"), F.col("l_partkey").alias("horse_id"),
        F.col("l_suppkey").alias("jockey_id"), F.year("l_shipdate").alias("year"), "l_quantity", "l_discount",
        F.when(F.col("l_returnflag") == "A", "graded").when(F.col("l_returnflag") == "N", "special").otherwise("regular").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "turf").otherwise("dirt").alias("surface"),
    )


RIDES = """rides AS (SELECT l_orderkey AS race_id, l_linenumber AS horse_number, l_partkey AS horse_id,
  l_suppkey AS jockey_id, CAST(year(l_shipdate) AS INT) AS year, l_quantity, l_discount,
  CASE l_returnflag WHEN 'A' THEN 'graded' WHEN 'N' THEN 'special' ELSE 'regular' END AS kind,
  CASE l_linestatus WHEN 'O' THEN 'turf' ELSE 'dirt' END AS surface FROM lineitem)"""


def jockey_long(spark: SparkSession, sf: str) -> DataFrame:
    r = rides(spark, sf)
    kinds = r.select("jockey_id", "year", "l_discount", F.explode(F.array("kind", "surface")).alias("category"))
    return kinds.groupBy("jockey_id", "year", "category").agg(
        F.count(F.lit(1)).alias("starts"), F.count_if(F.col("l_discount") >= 0.05).alias("wins")
    )


def jockey_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly placings with a summary row per jockey, year as text."""
    n = F.col("horse_number")
    aggs = [F.count_if(n == 1).alias("first"), F.count_if(n == 2).alias("second"), F.count_if(n == 3).alias("third"),
            F.count_if(n > 3).alias("other")]
    r = rides(spark, sf)
    yearly = r.groupBy("jockey_id", F.col("year").cast("string").alias("year_text")).agg(*aggs)
    return yearly.unionByName(r.groupBy("jockey_id").agg(*aggs).withColumn("year_text", F.lit("累計")))


# Scores of the runners of a race: lineitem with its order.
def scores(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 12 + 1).alias("round"),
        F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("surface"),
    )
    li = t(spark, sf, "lineitem")
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("race_id"), "date", "round", "class", "surface", F.col("l_linenumber").alias("horse_number"),
        F.col("l_partkey").alias("horse_id"), F.col("l_suppkey").alias("jockey_id"), q.alias("quantity"),
        (d * 5).alias("p1"), (x * 5).alias("p2"), (q / 100).alias("p3"), (q / 50).alias("p_other"), (q / 50).alias("top3_raw"),
        (d * 9).alias("top2_raw"), (x * 12).alias("win_raw"),
    )


SCORES = """scores AS (SELECT l_orderkey AS race_id, CAST(o_orderdate AS DATE) AS date, o_orderkey % 12 + 1 AS round,
  o_orderpriority AS class, o_orderstatus AS surface, l_linenumber AS horse_number, l_partkey AS horse_id,
  l_suppkey AS jockey_id, l_quantity AS quantity, l_discount * 5 AS p1, l_tax * 5 AS p2, l_quantity / 100 AS p3,
  l_quantity / 50 AS p_other, l_quantity / 50 AS top3_raw, l_discount * 9 AS top2_raw, l_tax * 12 AS win_raw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# Raw result rows as text, one per lineitem.
def raw_race(spark: SparkSession, sf: str) -> DataFrame:
    li, o, s = (t(spark, sf, n) for n in ("lineitem", "orders", "supplier"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    k, part, supp, line = (F.col(c) for c in ("o_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    qty = F.col("l_quantity").cast("int")
    seconds = F.lit(70) + (qty * 7 + part) % 60
    tenth = (supp % 10).cast("string")
    day = F.col("o_orderdate")
    columns = {
        "race_id": F.concat(F.year(day).cast("string"), F.lpad(k.cast("string"), 12, "0")),
        "horse": F.concat(F.lit("H"), part.cast("string")),
        "jockey": F.col("s_name"),
        "horse_number": line.cast("string"),
        "run_time": F.when(part % 50 == 0, "").otherwise(F.concat(
            F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("."), tenth)),
        "odds": F.when(supp % 20 == 0, "---").otherwise(F.concat(qty.cast("string"), F.lit("."), tenth)),
        "pass_order": F.concat_ws("-", line.cast("string"), qty.cast("string"), (part % 18 + 1).cast("string")),
        "rank": F.when((part + line) % 37 == 0, "中止").otherwise(((part + line) % 18 + 1).cast("string")),
        "weight": (part % 150 + 400).cast("int"),
        "weight_change": (supp % 21 - 10).cast("int"),
        "gender": pick(["牡", "牝", "セ"], part % 3),
        "age": (part % 7 + 2).cast("string"),
        "load": F.concat((part % 8 + 50).cast("string"), F.when(supp % 2 == 0, ".0").otherwise(".5")),
        "rise": F.concat((qty % 7 + 33).cast("string"), F.lit("."), tenth),
        "popularity": qty.cast("string"),
        "race_name": F.col("o_orderpriority"),
        "date": F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"),
                         F.dayofmonth(day).cast("string"), F.lit("日")),
        "event": F.concat((k % 6 + 1).cast("string"), F.lit("回"), F.col("o_orderstatus"), (k % 12 + 1).cast("string"), F.lit("日目")),
        "class": pick(CLASS_TEXTS, k % 15),
        "turf_or_dirt": pick(["芝", "ダ", "障"], k % 3),
        "distance": (k % 16 * 100 + 1000).cast("string"),
        "lap": pick(["右", "左", "芝", "直", "外"], k % 5),
        "racecourse": pick(["良", "稍", "重", "不"], k % 4),
        "weather": pick(["晴", "曇", "小", "雨", "雪"], F.floor(k / 7) % 5),
        "place_id": (k % 10).cast("int"),
        "place_name": pick(["札幌", "函館", "福島", "新潟", "東京", "中山", "中京", "京都", "阪神", "小倉"], k % 10),
        "update_at": F.date_format(F.date_add(F.to_date(day), 7), "yyyy-MM-dd 00:00:00"),
    }
    return joined.select(*[c.alias(n) for n, c in columns.items()])


_QTY = "CAST(l_quantity AS INT)"
_SEC = f"(70 + ({_QTY} * 7 + l_partkey) % 60)"
RAW_RACE = f"""raw_race AS (SELECT
  concat(year(o_orderdate), lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS race_id, concat('H', l_partkey) AS horse,
  s_name AS jockey, CAST(l_linenumber AS VARCHAR) AS horse_number,
  CASE WHEN l_partkey % 50 = 0 THEN '' ELSE concat({_SEC} // 60, ':', lpad(CAST({_SEC} % 60 AS VARCHAR), 2, '0'), '.', l_suppkey % 10) END AS run_time,
  CASE WHEN l_suppkey % 20 = 0 THEN '---' ELSE concat({_QTY}, '.', l_suppkey % 10) END AS odds,
  concat(l_linenumber, '-', {_QTY}, '-', l_partkey % 18 + 1) AS pass_order,
  CASE WHEN (l_partkey + l_linenumber) % 37 = 0 THEN '中止' ELSE CAST((l_partkey + l_linenumber) % 18 + 1 AS VARCHAR) END AS rank,
  CAST(l_partkey % 150 + 400 AS INT) AS weight, CAST(l_suppkey % 21 - 10 AS INT) AS weight_change,
  (['牡', '牝', 'セ'])[l_partkey % 3 + 1] AS gender, CAST(l_partkey % 7 + 2 AS VARCHAR) AS age,
  concat(l_partkey % 8 + 50, CASE WHEN l_suppkey % 2 = 0 THEN '.0' ELSE '.5' END) AS load,
  concat({_QTY} % 7 + 33, '.', l_suppkey % 10) AS rise, CAST({_QTY} AS VARCHAR) AS popularity, o_orderpriority AS race_name,
  concat(year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日') AS date,
  concat(o_orderkey % 6 + 1, '回', o_orderstatus, o_orderkey % 12 + 1, '日目') AS event,
  ({sql_list(CLASS_TEXTS)})[o_orderkey % 15 + 1] AS class, (['芝', 'ダ', '障'])[o_orderkey % 3 + 1] AS turf_or_dirt,
  CAST(o_orderkey % 16 * 100 + 1000 AS VARCHAR) AS distance, (['右', '左', '芝', '直', '外'])[o_orderkey % 5 + 1] AS lap,
  (['良', '稍', '重', '不'])[o_orderkey % 4 + 1] AS racecourse,
  (['晴', '曇', '小', '雨', '雪'])[(o_orderkey // 7) % 5 + 1] AS weather, CAST(o_orderkey % 10 AS INT) AS place_id,
  (['札幌', '函館', '福島', '新潟', '東京', '中山', '中京', '京都', '阪神', '小倉'])[o_orderkey % 10 + 1] AS place_name,
  strftime(CAST(o_orderdate AS DATE) + 7, '%Y-%m-%d 00:00:00') AS update_at, o_orderdate AS _day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
