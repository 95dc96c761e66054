"""Page parsing. The driver's pages hold no tables, so race markup is derived from each page's own links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.catalog.registry import query
from raceform.catalog.roles import CLASS_TEXTS, iso, pick, sql_list, t
from raceform.operators import pages as pg
from raceform.plans.form import jockey_years_of_pages
from raceform.session import materialize

LINK = r'<a href="([^"]*)">([^<]*)</a>'
STAMP = "2024-01-02 03:04:05"


def _texts() -> Column:
    return F.regexp_extract_all("html", F.lit(LINK), F.lit(2))


def _cells(*cells: Column | str) -> Column:
    parts = [p for c in cells for p in (F.lit("<td>"), F.lit(c) if isinstance(c, str) else c.cast("string"), F.lit("</td>\n"))]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>"))


def _rows(row) -> Column:
    return F.array_join(F.transform(_texts(), lambda text, i: row(text, i)), "\n")


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with race headings and, unless its number divides by 5, a result table of its links."""
    k = F.col("page_id")

    def row(text: Column, i: Column) -> Column:
        n = i + 1
        return _cells(
            F.when((k + i) % 7 == 0, "中止").otherwise(n.cast("string")), F.lit("1"), n,
            F.concat(F.lit('<a href="/horse/'), i.cast("string"), F.lit('/">'), text, F.lit("</a>")),
            F.concat(F.lit("牝"), (k % 12 + 2).cast("string")), F.lit("55.5"), F.concat(F.lit("J"), (k % 9).cast("string")),
            F.when((k + i) % 7 == 0, "").otherwise(F.concat(F.lit("1:3"), (i % 10).cast("string"), F.lit(".5"))), "", "",
            F.concat_ws("-", n.cast("string"), (i % 4).cast("string")), F.lit("34.5"), F.when(i == 3, "---").otherwise("9.9"), n,
            F.when(i % 3 == 0, F.concat((i + 470).cast("string"), F.lit("(前計不)"))).when(i % 3 == 1, F.concat((i + 470).cast("string"), F.lit("(+2)"))).otherwise("計不"))

    header = F.concat(pick(["芝", "ダ"], k % 2), pick(["右", "左"], k % 2), (k % 16 * 100 + 1000).cast("string"),
                      F.lit("m&nbsp;/&nbsp;天候 : "), pick(["晴", "曇", "小雨"], k % 3), F.lit("&nbsp;/&nbsp;"), pick(["芝", "ダート"], k % 2),
                      F.lit(" : "), pick(["良", "稍重"], k % 2), F.lit("&nbsp;/&nbsp;発走 : 15:35"))
    spans = [F.when(k % 3 == 8 - i, header).otherwise("menu") if i >= 6 else F.lit("menu") for i in range(9)]
    small = F.concat(F.lit('<p class="smalltxt">1998年'), (k % 12 + 1).cast("string"), F.lit("月7日 "), (k % 6 + 1).cast("string"),
                     F.lit("回中京7日目 "), pick(CLASS_TEXTS, k % 15), F.lit("&nbsp;&nbsp;(混)</p>"))
    table = F.concat(F.lit(f'<table class="{pg.RESULT_TABLE_CLASS}" summary="r"><tr><th>着順</th></tr>\n'), _rows(row), F.lit("</table>"))
    derived = t(spark, sf, "pages").select(
        "page_id", "url", F.concat(F.lit("1998"), F.lpad(k.cast("string"), 8, "0")).alias("current_race_id"), (k % 10).cast("int").alias("racecourse_i"),
        F.lit("中京").alias("place"), (k % 12).cast("int").alias("race_number_i"), F.lit(1998).alias("year"),
        F.concat("html", F.lit("<h1>Race "), k.cast("string"), F.lit("</h1>"), *[x for s in spans for x in (F.lit("<span>"), s, F.lit("</span>"))],
                 small, F.when(k % 5 > 0, table).otherwise("")).alias("html"))
    # Stored as a page table would be; otherwise the markup is rebuilt for every field read from it.
    return materialize(derived, "pages")


# The link texts as SQL sees them: decoded, trimmed, numbered.
LINKS = rf"""links AS (SELECT page_id, url, i - 1 AS i, page_id AS k,
  trim(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS horse
  FROM (SELECT page_id, url, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '{LINK}', 2) AS l FROM pages) a) b)"""

RESULT_SQL = f"""SELECT concat('1998', lpad(CAST(k AS VARCHAR), 8, '0')) AS race_id, horse, concat('J', k % 9) AS jockey, CAST(i + 1 AS VARCHAR) AS horse_number,
  CASE WHEN (k + i) % 7 = 0 THEN '' ELSE concat('1:3', i % 10, '.5') END AS run_time, CASE WHEN i = 3 THEN '---' ELSE '9.9' END AS odds,
  concat(i + 1, '-', i % 4) AS pass_order, CASE WHEN (k + i) % 7 = 0 THEN '中止' ELSE CAST(i + 1 AS VARCHAR) END AS rank,
  CAST(CASE WHEN i % 3 = 2 THEN 0 ELSE i + 470 END AS INT) AS weight, CASE WHEN i % 3 = 1 THEN 2 ELSE 0 END AS weight_change, '牝' AS gender,
  CAST(k % 12 + 2 AS VARCHAR) AS age, '55.5' AS load, '34.5' AS rise, CAST(i + 1 AS VARCHAR) AS popularity, concat('Race ', k) AS race_name,
  concat('1998年', k % 12 + 1, '月7日') AS date, concat(k % 6 + 1, '回中京7日目') AS event, ({sql_list(CLASS_TEXTS)})[k % 15 + 1] AS class,
  (['芝', 'ダ'])[k % 2 + 1] AS turf_or_dirt, CAST(k % 16 * 100 + 1000 AS VARCHAR) AS distance, (['右', '左'])[k % 2 + 1] AS lap,
  (['良', '稍'])[k % 2 + 1] AS racecourse, (['晴', '曇', '小'])[k % 3 + 1] AS weather, CAST(k % 10 AS INT) AS place_id, '中京' AS place_name,
  '{STAMP}' AS update_at FROM links WHERE k % 5 > 0"""


@query("H1_result_tables", f"WITH {LINKS} {RESULT_SQL}")
def result_tables(spark: SparkSession, sf: str) -> DataFrame:
    return pg.parse_results(result_pages(spark, sf), F.lit(STAMP).cast("timestamp"))


@query("H2_race_header", """SELECT page_id, (['芝', 'ダ'])[page_id % 2 + 1] AS turf_or_dirt, (['右', '左'])[page_id % 2 + 1] AS lap,
  CAST(page_id % 16 * 100 + 1000 AS VARCHAR) AS distance, (['晴', '曇', '小'])[page_id % 3 + 1] AS weather, (['良', '稍'])[page_id % 2 + 1] AS racecourse FROM pages""")
def race_header(spark: SparkSession, sf: str) -> DataFrame:
    parts = result_pages(spark, sf).select("page_id", *[c.alias(n) for n, c in pg.page_parts(F.col("html")).items()])
    return parts.select("page_id", *[c.alias(n) for n, c in pg.race_header().items()])


@query("H3_headings", rf"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, concat('Race ', page_id) AS race_name, concat('1998年', page_id % 12 + 1, '月7日') AS date,
  concat(page_id % 6 + 1, '回中京7日目') AS event, ({sql_list(CLASS_TEXTS)})[page_id % 15 + 1] AS class FROM pages""")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    parts = result_pages(spark, sf).select("page_id", pg.title(html).alias("title"), *[c.alias(n) for n, c in pg.page_parts(html).items()])
    return parts.select("page_id", "title", *[c.alias(n) for n, c in pg.race_heading().items()])


@query("H4_links", r"""SELECT page_id, pos - 1 AS pos, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages) a) b""")
def links(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", F.posexplode(pg.links(F.col("html"))).alias("pos", "link"))


def horse_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Horse pages with three leading tables, an awards table on every other page, then the results."""
    k = F.col("page_id")
    heads = "".join(f"<th>{h[0]} {h[1:]}</th>" for h in ("開催", *pg.HISTORY_COLUMNS))

    def row(text: Column, i: Column) -> Column:
        return _cells(F.lit("x"), F.concat(F.lit("1998/"), (i % 12 + 1).cast("string"), F.lit("/7")), i + 1,
                      F.concat((i + 1).cast("string"), F.lit(",234.5")), F.concat(F.lit("3"), (i % 10).cast("string"), F.lit(".1")),
                      F.concat_ws("-", (i + 1).cast("string"), F.lit("4")))

    awards = F.when(k % 2 == 0, "<table><tr><th>受賞歴</th></tr><tr><td>a</td></tr></table>").otherwise("")
    results = F.when(k % 4 != 3, F.concat(F.lit(f"<table><tr>{heads}</tr>"), _rows(row), F.lit("</table>"))).otherwise("")
    sires = [F.concat(F.lit('<td class="b_ml"><a href="/horse/ped/'), F.lit(x), k.cast("string"), F.lit('/">s</a></td>')) for x in ("f", "g", "m")]
    prof = F.concat(F.lit('<a href="/breeder/1/" title="B'), (k % 5).cast("string"), F.lit('">b</a>'))
    return t(spark, sf, "pages").select(
        F.lpad(k.cast("string"), 10, "0").alias("horse_id"),
        F.concat("html", prof, *sires, F.lit("<table></table><table></table><table></table>"), awards, results).alias("html"))


@query("H5_nth_table", f"""WITH {LINKS} SELECT lpad(CAST(page_id AS VARCHAR), 10, '0') AS horse_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE
  (SELECT count(*) FROM links l WHERE l.page_id = p.page_id) + 1 END AS rows_in_table FROM pages p""")
def nth_table(spark: SparkSession, sf: str) -> DataFrame:
    table = pg.nth_table(F.col("html"), 3)
    return horse_pages(spark, sf).select("horse_id", F.when(table.isNotNull(), F.size(pg.table_rows(table))).cast("bigint").alias("rows_in_table"))


def entry_pages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    heads = "".join(f"<th>{h[0]}\n{h[1:]}</th>" for h in pg.ENTRY_COLUMNS)

    def row(text: Column, i: Column) -> Column:
        jockey = F.when((k % 6 == 0) & (i == 0), "J").otherwise(F.concat(
            F.lit('<a href="https://example.com/jockey/result/recent/'), F.lpad((k % 50).cast("string"), 5, "0"), F.lit('/">J</a>')))
        horse = F.concat(F.lit('<td class="HorseInfo"><a href="https://example.com/horse/'), F.lpad((k * 100 + i).cast("string"), 10, "0"), F.lit('">'), text, F.lit("</a></td>"))
        return F.concat(F.lit("<tr><td>1</td><td>"), (i + 1).cast("string"), F.lit("</td>"), horse, F.lit("<td>牡4</td><td>55.0</td>"),
                        F.lit('<td class="Jockey">'), jockey, F.lit("</td><td>美浦X</td><td>480(+2)</td></tr>"))

    return t(spark, sf, "pages").select(
        F.lpad(k.cast("string"), 12, "0").alias("race_id"), F.concat("html", F.lit(f"<table><tr>{heads}</tr>"), _rows(row), F.lit("</table>")).alias("html"))


@query("H6_entry_table", f"""WITH {LINKS} SELECT lpad(CAST(k AS VARCHAR), 12, '0') AS race_id, '1' AS bracket, CAST(i + 1 AS VARCHAR) AS horse_number, horse AS horse_name,
  '牡4' AS sex_age, '55.0' AS load, 'J' AS jockey_name, '美浦X' AS stable, '480(+2)' AS weight_text, lpad(CAST(k * 100 + i AS VARCHAR), 10, '0') AS horse_id,
  lpad(CAST(k % 50 AS VARCHAR), 5, '0') AS jockey_id FROM links WHERE k % 6 > 0""")
def entry_table(spark: SparkSession, sf: str) -> DataFrame:
    return pg.parse_entries(entry_pages(spark, sf))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    return t(spark, sf, "pages").where(k % 10 == 0).select(F.lpad(k.cast("string"), 10, "0").alias("horse_id"))


@query("H7_horse_pages", f"""WITH {LINKS} SELECT lpad(CAST(k AS VARCHAR), 10, '0') AS horse_id, concat('1998-', lpad(CAST(i % 12 + 1 AS VARCHAR), 2, '0'), '-07') AS date,
  CAST(i + 1 AS VARCHAR) AS rank, CAST(concat(i + 1, '234.5') AS DOUBLE) AS prize, CAST(concat('3', i % 10, '.1') AS DOUBLE) AS last3f, concat(i + 1, '-4') AS passing,
  concat('B', k % 5) AS breeder, concat('f', k) AS sire_id, concat('g', k) AS sire_sire_id, concat('m', k) AS dam_sire_id FROM links WHERE k % 4 <> 3 AND k % 10 <> 0""")
def horse_history(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = pg.parse_horse_pages(horse_pages(spark, sf), _known(spark, sf))
    return rows.withColumn("date", iso("date"))


@query("H7_unreadable_pages", "SELECT lpad(CAST(page_id AS VARCHAR), 10, '0') AS horse_id FROM pages WHERE page_id % 4 = 3 AND page_id % 10 <> 0")
def unreadable_pages(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = pg.parse_horse_pages(horse_pages(spark, sf), _known(spark, sf))
    return bad.select("horse_id")


_KINDS = list(pg.JOCKEY_KINDS.values())


def jockey_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A result table per page with two heading rows, a year per link, a summary row first and a table inside a cell; every sixth page has no year column."""
    k = F.col("page_id")

    def numbers(i: Column) -> list[Column]:
        counts = [i + 1, k % 5, F.lit(2), k % 7]
        for j in range(len(_KINDS)):
            counts += [i + j + 3, (i + j) % 3]
        return counts

    def row(year: Column, counts: list[Column], rates: list[str]) -> Column:
        inner = F.lit("<td>x<TABLE class='t'><tr><th>年度</th><td>9</td></tr></TABLE></td>")
        tds = [x for c in (F.lit("1"), *counts) for x in (F.lit("<td align=right>"), c.cast("string"), F.lit("</td>\n"))]
        return F.concat(F.lit("<tr><td>"), year, F.lit("</td>"), *tds, inner, *[F.lit(f"<TD>{r}</TD>") for r in rates], F.lit("</tr>"))

    heads = "".join(f'<th rowspan="2">{h}</th>' for h in ("順位", *pg.JOCKEY_PLACES))
    kinds = "".join(f'<TH colspan="2">{h}</TH>' for h in pg.JOCKEY_KINDS)
    tail = "".join(f'<th rowspan=2 class="r">{h}</th>' for h in ("所属", *pg.JOCKEY_RATES))
    first = F.concat(F.lit("<div><Table class='nk'><thead><tr>"), F.when(k % 6 == 5, F.lit('<th rowspan="2">年</th>')).otherwise(F.lit('<th rowspan="2">年度</th>')),
                     F.lit(heads + kinds + tail + "</tr><tr>" + "<th>出走</th><th>勝利</th>" * len(_KINDS) + "</tr></thead>"))
    years = F.transform(_texts(), lambda text, i: row((1990 + i).cast("string"), numbers(i), ["0.1", "0.2", "0.3"]))
    total = row(F.lit(pg.SUMMARY_YEAR), [F.lit(1)] * (4 + 2 * len(_KINDS)), ["．1", "0.25", "45.5%"])
    html = F.concat("html", first, total, F.array_join(years, ""), F.lit("</table></div><table><tr><td>1</td></tr></table>"))
    # The pages hold no tables of their own.
    return materialize(t(spark, sf, "pages").select(F.concat(F.lit("j"), k.cast("string")).alias("jockey_id"), F.regexp_replace(html, r"(?i)^<!doctype[^>]*>", "").alias("html")), "jockey-pages")


def _jockey_sql() -> str:
    kinds = ", ".join(f"i + {j} + 3 AS {n}_starts, (i + {j}) % 3 AS {n}_wins" for j, n in enumerate(_KINDS))
    return f"""WITH {LINKS} SELECT concat('j', k) AS jockey_id, CAST(1990 + i AS INT) AS year, i + 1 AS first, k % 5 AS second, 2 AS third, k % 7 AS other, {kinds},
      i + 1 + k % 5 + 2 + k % 7 AS starts, i + 1 + k % 5 + 2 AS top3 FROM links WHERE k % 6 <> 5 AND k % 10 <> 0"""


@query("H7_jockey_pages", _jockey_sql())
def jockey_years(spark: SparkSession, sf: str) -> DataFrame:
    """From pages to the yearly table that the jockey rates come from; every tenth jockey is known."""
    known = t(spark, sf, "pages").where("page_id % 10 = 0").select(F.concat(F.lit("j"), F.col("page_id").cast("string")).alias("jockey_id"))
    yearly, _, _ = pg.parse_jockey_pages(jockey_pages(spark, sf), known)
    return jockey_years_of_pages(yearly)


@query("H7_jockey_rates", "SELECT concat('j', page_id) AS jockey_id, CASE WHEN page_id % 6 <> 5 THEN 0.25::DOUBLE END AS top2_rate, CASE WHEN page_id % 6 <> 5 THEN 45.5::DOUBLE END AS top3_rate FROM pages")
def jockey_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Overall rates of the first row, and the pages that could not be read, without rates."""
    _, rates, bad = pg.parse_jockey_pages(jockey_pages(spark, sf))
    return rates.drop("win_rate").unionByName(bad.select("jockey_id"), allowMissingColumns=True)
