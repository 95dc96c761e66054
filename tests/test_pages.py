from pyspark.sql import functions as F

from raceform.operators import pages as pg
from raceform.plans.ingest import ingest
from raceform.schemas import RAW_RACE

SPANS = "".join(f"<span>{'芝右1200m&nbsp;/&nbsp;天候 : 晴&nbsp;/&nbsp;芝 : 良&nbsp;/&nbsp;発走 : 15:35' if i == 7 else 'x'}</span>" for i in range(9))
HEAD = f'<h1>site</h1>{SPANS}<h1>Some <b>Stakes</b></h1><p class="smalltxt">2019年7月27日 2回中京7日目 3歳以上1勝クラス&nbsp;&nbsp;(混)</p>'


def row(rank, horse, weight="480(+4)", cells=15):
    values = [rank, "1", "7", f'<a href="/horse/1/">{horse}</a>', "牡10", "55.0", " J ", "1:34.5", "", "", "3-4-10", "34.5", "9.9", "1", weight]
    return "<tr>" + "".join(f'<td nowrap="nowrap">{v}</td>' for v in values[:cells]) + "</tr>"


def page(*rows):
    return HEAD + f'<table class="{pg.RESULT_TABLE_CLASS}" summary="x"><tr><th>rank</th></tr>' + "\n".join(rows) + "</table>"


def pages(spark, **htmls):
    rows = [(f"u/{k}", k, 4, "東京", 0, 2019, v) for k, v in htmls.items()]
    return spark.createDataFrame(rows, "url string, current_race_id string, racecourse_i int, place string, race_number_i int, year int, html string")


def test_simple_table(spark):
    html = "<table><tr><th>a</th></tr><tr><td>1</td><td> x </td></tr></table>"
    df = spark.createDataFrame([(html,)], "html string")
    rows = pg.table_rows(F.get(pg.inner(F.col("html"), "table"), F.lit(0)))
    assert df.select(F.transform(rows, lambda r: pg.row_cells(r)).alias("x")).first()["x"] == [[], ["1", "x"]]


def test_result_page(spark):
    p = pages(spark, r1=page(row("1", "A&amp;B"), row("中止", "C", "計不"), row("2", "D", "470(前計不)")), r2=HEAD)
    got = pg.parse_results(p, F.lit("2024-01-02 03:04:05").cast("timestamp")).orderBy("horse")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in RAW_RACE]
    rows = got.collect()
    assert [(r["horse"], r["rank"], r["weight"], r["weight_change"]) for r in rows] == [("A&B", "1", 480, 4), ("C", "中止", 0, 0), ("D", "2", 470, 0)]
    a = rows[0].asDict()
    assert a["gender"] == "牡" and a["age"] == "10" and a["jockey"] == "J" and a["race_name"] == "Some Stakes"
    assert (a["date"], a["event"], a["class"]) == ("2019年7月27日", "2回中京7日目", "3歳以上1勝クラス")
    assert (a["turf_or_dirt"], a["lap"], a["distance"], a["weather"], a["racecourse"]) == ("芝", "右", "1200", "晴", "良")
    assert (a["place_id"], a["place_name"], a["update_at"]) == (4, "東京", "2024-01-02 03:04:05")


def test_ingest_twice_adds_nothing_and_retries_pages_without_table(spark, tmp_path):
    raw, seen = str(tmp_path / "raw"), str(tmp_path / "seen")
    p = pages(spark, r1=page(row("1", "A"), row("2", "B")), r2=HEAD)
    for _ in range(2):
        ingest(p, p.drop("html"), raw, seen)
    assert spark.read.parquet(raw).count() == 2
    assert [r["url"] for r in spark.read.parquet(seen).collect()] == ["u/r1"]
    later = pages(spark, r1=page(row("9", "Z")), r2=page(row("1", "E")))
    ingest(later, later.drop("html"), raw, seen)
    assert sorted(r["horse"] for r in spark.read.parquet(raw).collect()) == ["A", "B", "E"]


def test_awards_table_is_skipped(spark):
    other = "<table><tr><th>x</th></tr></table>"
    awards = "<table><tr><th>受賞歴</th></tr></table>"
    df = spark.createDataFrame([(other * 3 + awards + "<table>R</table>",), (other * 3 + "<table>S</table>",), (other,)], "html string")
    assert [r[0] for r in df.select(pg.nth_table(F.col("html"), 3)).collect()] == ["R", "S", None]


def test_spanned_cells(spark):
    row = ('<TD>12</TD><td align=right> 3,4 </td><TH ColSpan=2 class="a">x&amp;y<b>z</b></TH><th rowspan="2">年度</th>'
           '<td rowspan="0"> 1 </td><td colspan="99999999999"></td><td data-x="SPAN">a &lt;b&gt;</td>')
    cells = spark.range(1).select(pg.spanned_cells(F.lit(row)).alias("c"), pg.spanned_cells(F.lit(None).cast("string")).alias("none")).first()
    assert [tuple(c) for c in cells.c] == [
        ("12", 1, 1, False), ("3,4", 1, 1, False), ("x&yz", 2, 1, True), ("年度", 1, 2, True), ("1", 1, 1, False), ("", 1, 1, False), ("a <b>", 1, 1, False)]
    assert cells.none is None
