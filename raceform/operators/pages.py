"""Page parsing as column expressions over a page table (one HTML text per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceform.functions import text as tx
from raceform.schemas import RAW_RACE
from raceform.session import materialize

# Markup of the race pages and the meaning of result-table cells.
RESULT_TABLE_CLASS = "race_table_01 nk_tb_common"
RESULT_CELLS = {
    "rank": 0, "horse_number": 2, "horse": 3, "sex_age": 4, "load": 5, "jockey": 6, "run_time": 7,
    "pass_order": 10, "rise": 11, "odds": 12, "popularity": 13, "weight_text": 14,
}
HEADER_SPANS = (7, 3)  # 1-based start and length: the span numbered 8 from 0, else 7, else 6
HEADER_SPAN = r"^..[^/]*m[^/]*/[^/:]*:[^/]*/[^/:]*:"
AWARDS_HEADER = "受賞歴"
ENTRY_COLUMNS = {
    "枠": "bracket", "馬番": "horse_number", "馬名": "horse_name", "性齢": "sex_age", "斤量": "load",
    "騎手": "jockey_name", "厩舎": "stable", "馬体重(増減)": "weight_text",
}
HISTORY_COLUMNS = {"日付": "date", "着順": "rank", "賞金": "prize", "上り": "last3f", "通過": "passing"}


def plain_text(markup: Column) -> Column:
    """Tags removed, common entities decoded, outer whitespace trimmed."""
    text = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("\u00a0", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def inner(html: Column, tag: str, attributes: str = "[^>]*") -> Column:
    """Contents of all ``tag`` elements (not nested in themselves), in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}(?:\s{attributes})?>(.*?)</{tag}>"), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def cell_links(html: Column, cell_class: str) -> Column:
    """First link of each table cell of a class."""
    pattern = rf'(?s)<td[^>]*class="{cell_class}"[^>]*>(?:(?!</td>).)*?<a[^>]*href="([^"]*)"'
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def table_rows(table: Column) -> Column:
    return inner(table, "tr")


def row_cells(row: Column, tag: str = "td") -> Column:
    return F.transform(inner(row, tag), plain_text)


def nth_table(html: Column, n: int) -> Column:
    """The n-th table, or the one after it when the n-th is the awards table."""
    tables = inner(html, "table")
    first_header = F.get(row_cells(F.get(tables, F.lit(n)), "th"), F.lit(0))
    return F.when(first_header == AWARDS_HEADER, F.get(tables, F.lit(n + 1))).otherwise(F.get(tables, F.lit(n)))


def page_parts(html: Column) -> dict[str, Column]:
    """The pieces of a result page that several fields come from; select them first, so each is searched once."""
    spans = F.transform(inner(html, "span"), plain_text)
    candidates = F.reverse(F.slice(spans, *HEADER_SPANS))
    small = plain_text(F.regexp_extract(html, r'(?s)<p class="smalltxt">(.*?)</p>', 1))
    table = F.regexp_extract(html, rf'(?s)<table[^>]*class="{RESULT_TABLE_CLASS}"[^>]*>(.*?)</table>', 1)
    return {
        "_header": F.split(F.get(F.filter(candidates, lambda s: s.rlike(HEADER_SPAN)), F.lit(0)), "/"),
        "_heading": F.split(small, r"\s+"),
        "_name": plain_text(F.get(inner(html, "h1"), F.lit(1))),
        "_rows": table_rows(table),
    }


def race_header(parts: Column | str = "_header") -> dict[str, Column]:
    """Surface, direction, distance, weather and going from the header text, split at slashes."""
    first = F.get(parts, F.lit(0))

    def after_colon(i: int) -> Column:
        return F.regexp_extract(F.get(parts, F.lit(i)), r":\s*(\S)", 1)

    return {
        "turf_or_dirt": F.substring(first, 1, 1),
        "lap": F.substring(first, 2, 1),
        "distance": F.regexp_extract(first, r"(\d{1,4})m", 1),
        "weather": after_colon(1),
        "racecourse": after_colon(2),
    }


def race_heading(words: Column | str = "_heading", name: str = "_name") -> dict[str, Column]:
    """Race name (second ``h1``), date, meeting and class from the words of the small text line."""
    return {
        "race_name": F.col(name),
        "date": F.get(words, F.lit(0)),
        "event": F.get(words, F.lit(1)),
        "class": F.get(words, F.lit(2)),
    }


def parse_results(pages: DataFrame, parsed_at: Column | None = None) -> DataFrame:
    """Result pages to raw race rows.

    ``pages`` has ``html`` and the candidate columns ``current_race_id, racecourse_i, place``.
    Pages without a result table yield no rows. ``parsed_at`` defaults to the current time.
    """
    stamp = parsed_at if parsed_at is not None else F.current_timestamp()
    split = pages.select("current_race_id", "racecourse_i", "place", *[c.alias(n) for n, c in page_parts(F.col("html")).items()])
    page_level = {**race_header(), **race_heading()}
    rows = split.select(
        F.col("current_race_id").alias("race_id"), F.col("racecourse_i").cast("int").alias("place_id"),
        F.col("place").alias("place_name"), *[c.alias(n) for n, c in page_level.items()],
        F.explode(F.slice(F.col("_rows"), F.lit(2), F.size("_rows"))).alias("_row"),
    ).withColumn("_cells", row_cells(F.col("_row")))
    cells = {name: F.get("_cells", F.lit(i)) for name, i in RESULT_CELLS.items()}
    values = {
        **{n: F.coalesce(cells[n], F.lit("")) if n in ("run_time", "pass_order", "rise", "popularity") else cells[n]
           for n in cells if n not in ("sex_age", "weight_text")},
        "gender": tx.sex(cells["sex_age"]),
        "age": F.substr(cells["sex_age"], F.lit(2)),
        "weight": tx.body_weight(cells["weight_text"]),
        "weight_change": tx.body_weight_change(cells["weight_text"]),
        "update_at": F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"),
    }
    return rows.select(*[
        values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RAW_RACE.fields
    ])


def has_results(html: Column) -> Column:
    return html.rlike(rf'<table[^>]*class="{RESULT_TABLE_CLASS}"')


def table_by_header(pages: DataFrame, table: Column, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """Rows of one table per page, cells chosen by header text (blanks in headers ignored)."""
    rows = pages.select(*keep, table_rows(table).alias("_rows")).withColumn(
        "_header", F.transform(row_cells(F.get("_rows", F.lit(0)), "th"), lambda h: F.regexp_replace(h, r"\s", ""))
    )
    exploded = rows.where(F.size("_rows") > 1).select(
        *keep, "_header", F.posexplode(F.slice(F.col("_rows"), F.lit(2), F.size("_rows"))).alias("_pos", "_row")
    ).withColumn("_cells", row_cells(F.col("_row")))

    def cell(header: str) -> Column:
        at = F.array_position("_header", F.lit(header))
        return F.when(at > 0, F.get("_cells", (at - 1).cast("int")))

    return exploded.select(*keep, "_pos", *[cell(h).alias(n) for h, n in columns.items()])


def parse_entries(pages: DataFrame) -> DataFrame:
    """Entry pages ``(race_id, html)`` to entry rows with horse and jockey ids, complete races only."""
    keyed = pages.select(
        "race_id", "html",
        F.transform(cell_links(F.col("html"), "HorseInfo"), lambda h: tx.link_id(h, "horse")).alias("_horses"),
        F.transform(cell_links(F.col("html"), "Jockey"), lambda h: tx.link_id(h, "jockey")).alias("_jockeys"),
    ).withColumn("_n", F.size(table_rows(F.get(inner(F.col("html"), "table"), F.lit(0)))) - 1).where(
        (F.size("_horses") == F.col("_n")) & (F.size("_jockeys") == F.col("_n"))
    )
    rows = table_by_header(
        keyed, F.get(inner(F.col("html"), "table"), F.lit(0)), ENTRY_COLUMNS, ["race_id", "_horses", "_jockeys"]
    )
    return rows.select(
        "race_id", *ENTRY_COLUMNS.values(),
        F.get("_horses", F.col("_pos")).alias("horse_id"), F.get("_jockeys", F.col("_pos")).alias("jockey_id"),
    )


def parse_horse_pages(pages: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Horse pages ``(horse_id, html)`` to history rows, and the pages that could not be read.

    Ids in ``known`` are skipped. A page that lacks the table or the three ancestor links goes
    to the second table instead of stopping the run.
    """
    fresh = pages if known is None else pages.join(known.select("horse_id"), "horse_id", "left_anti")
    html = F.col("html")
    ancestors = F.transform(cell_links(html, "b_ml"), lambda h: tx.link_id(h, "horse"))
    marked = fresh.withColumn("_table", nth_table(html, 3)).withColumn("_ancestors", ancestors)
    readable = F.col("_table").isNotNull() & (F.size("_ancestors") >= 3)
    good = marked.where(readable).select(
        "horse_id", "_table", F.regexp_extract("html", r'<a[^>]*breeder[^>]*title="([^"]*)"', 1).alias("breeder"),
        *[F.get("_ancestors", F.lit(i)).alias(n) for i, n in enumerate(("sire_id", "sire_sire_id", "dam_sire_id"))],
    )
    keep = ["horse_id", "breeder", "sire_id", "sire_sire_id", "dam_sire_id"]
    rows = table_by_header(good, F.col("_table"), HISTORY_COLUMNS, keep)
    history = rows.select(
        "horse_id", tx.race_date(F.col("date")).alias("date"), "rank",
        tx.to_double(F.replace("prize", F.lit(","), F.lit(""))).alias("prize"),
        tx.to_double(F.col("last3f")).alias("last3f"), "passing", *keep[1:],
    )
    return history, marked.where(~readable).select("horse_id", "html")


def with_tables(pages: DataFrame, name: str) -> DataFrame:
    """``pages`` with the markup of every table of ``html`` in page order, without the tables inside it. Tags may be in capitals; an open table ends with the page.

    A few selections one after the other, so that what a lambda looks at is a column and not worked out again for each element.
    """
    opens, closes = (lambda p: p.rlike(r"(?i)^<table[\s>]")), (lambda p: p.rlike(r"(?i)^</table[\s>]"))
    step = lambda p: F.when(opens(p), 1).when(closes(p), -1).otherwise(0)
    # How many tables are open after each piece.
    depths = F.aggregate("_pieces", F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + step(p))))

    def own(at: Column) -> Column:
        rest = F.slice("_pieces", at + 2, F.size("_pieces"))
        inside = F.filter(
            F.transform(rest, lambda p, i: F.struct(p.alias("piece"), F.get("_depths", at + 1 + i).alias("depth"), (at + 1 + i).alias("place"))),
            lambda r: (r["depth"] == F.get("_depths", at)) & (r["place"] < F.get("_ends", at)))
        first = F.regexp_replace(F.get("_pieces", at), r"(?i)^<table[^>]*>", "")
        return F.concat(first, F.array_join(F.transform(inside, lambda r: F.regexp_replace(r["piece"], r"(?i)^</?table[^>]*>", "")), ""))

    pieces = pages.withColumn("_pieces", F.split("html", r"(?i)(?=</?table[\s>])")).withColumn("_depths", depths)
    # Where each piece's level ends: at the first later piece with fewer open tables.
    later = lambda d, i: F.array_position(F.transform(F.slice("_depths", i + 2, F.size("_depths")), lambda x: x < d), F.lit(True)).cast("int")
    ends = F.transform(F.transform("_depths", later), lambda e, i: F.when(e > 0, i + e).otherwise(F.size("_depths")))
    starts = F.filter(F.transform("_pieces", lambda p, i: F.when(opens(p), i)), lambda i: i.isNotNull())
    return pieces.withColumn("_ends", ends).withColumn("_starts", starts).withColumn(name, F.transform("_starts", own)).drop("_pieces", "_depths", "_ends", "_starts")


def spanned_cells(row: Column) -> Column:
    """Cells of a row (text, wide, tall, head): how many columns and rows a cell covers, and whether it is a heading.

    Most cells are a plain number in a plain tag, so the searches that clean a text or read a span run only where there is something to find.
    """
    cells = F.regexp_extract_all(row, F.lit(r"(?is)(<t[hd](?:\s[^>]*)?>.*?)</t[hd]>"), F.lit(1))
    parts = F.transform(cells, lambda c: F.struct(F.lower(F.substring_index(c, ">", 1)).alias("tag"), F.substr(c, F.position(F.lit(">"), c) + 1).alias("text")))

    def span(tag: Column, name: str) -> Column:
        found = F.regexp_extract(tag, rf'(?s)^<[^>]*{name}="?(\d+)', 1).try_cast("int")
        return F.when(tag.contains(name), F.greatest(F.coalesce(found, F.lit(1)), F.lit(1))).otherwise(1)

    return F.transform(parts, lambda c: F.struct(
        F.when(c["text"].rlike(r"[<&\s\u00a0]"), plain_text(c["text"])).otherwise(c["text"]).alias("text"),
        span(c["tag"], "colspan").alias("wide"), span(c["tag"], "rowspan").alias("tall"), c["tag"].startswith("<th").alias("head")))


def with_two_level_names(rows: DataFrame, first: Column, second: Column, name: str) -> DataFrame:
    """``rows`` with the names ``upper|lower`` of the columns under two heading rows; a heading that covers both rows is both."""
    top = F.flatten(F.transform(first, lambda c: F.array_repeat(F.struct(c["text"].alias("text"), (c["tall"] > 1).alias("both")), c["wide"])))
    low = F.flatten(F.transform(second, lambda c: F.array_repeat(c["text"], c["wide"])))
    below = lambda i: F.size(F.filter(F.slice("_top", F.lit(1), i + 1), lambda t: ~t["both"])) - 1
    names = F.transform("_top", lambda t, i: F.concat_ws("|", t["text"], F.when(t["both"], t["text"]).otherwise(F.get("_low", below(i)))))
    return rows.withColumns({"_top": top, "_low": low}).withColumn(name, names).drop("_top", "_low")


# Headings of a jockey's result table.
SUMMARY_YEAR = "累計"
JOCKEY_PLACES = {"1着": "first", "2着": "second", "3着": "third", "着外": "other"}
JOCKEY_KINDS = {"重賞": "graded", "特別": "special", "平場": "regular", "芝": "turf", "ダート": "dirt"}
JOCKEY_RATES = {"勝率": "win_rate", "連対率": "top2_rate", "複勝率": "top3_rate"}


def parse_jockey_pages(pages: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jockey pages ``(jockey_id, html)`` to yearly rows, overall rates, and the pages that could not be read.

    Yearly rows have the placings and, per kind of race, starts and wins, without the summary row. The rates are those of the first
    row of the page, the summary. Ids in ``known`` are skipped. A page without a table that has two heading rows and a year column goes
    to the third table instead of stopping the run.
    """
    fresh = pages if known is None else pages.join(known.select("jockey_id"), "jockey_id", "left_anti")
    rows = F.regexp_extract_all(F.get("_tables", F.lit(0)), F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1))
    cells = with_tables(fresh, "_tables").withColumn("_rows", rows).withColumn("_cells", F.transform("_rows", spanned_cells)).drop("_tables", "_rows")
    heading = lambda i: F.coalesce(F.forall(F.get("_cells", F.lit(i)), lambda c: c["head"]), F.lit(False))
    headed = [F.when(heading(0) & heading(1), F.get("_cells", F.lit(i))) for i in (0, 1)]
    # Stored, since three tables are made from it.
    named = materialize(with_two_level_names(cells, *headed, "_names"), "jockey-cells")
    year = "年度|年度"
    readable = F.coalesce(F.array_contains("_names", year), F.lit(False))
    body = named.where(readable).select("jockey_id", "_names", F.posexplode(F.slice("_cells", F.lit(3), F.size("_cells"))).alias("_row", "_body"))

    def cell(name: str) -> Column:
        at = F.array_position("_names", F.lit(name))
        return F.when(at > 0, F.get("_body", (at - 1).cast("int"))["text"])

    def whole(name: str) -> Column:
        return F.replace(cell(name), F.lit(","), F.lit("")).try_cast("bigint")

    counts = {n: whole(f"{h}|{h}") for h, n in JOCKEY_PLACES.items()}
    for h, n in JOCKEY_KINDS.items():
        counts |= {f"{n}_starts": whole(f"{h}|出走"), f"{n}_wins": whole(f"{h}|勝利")}
    yearly = body.where(cell(year) != SUMMARY_YEAR).select("jockey_id", cell(year).try_cast("int").alias("year"), *[c.alias(n) for n, c in counts.items()])
    rates = body.where("_row = 0").select("jockey_id", *[tx.to_double(F.regexp_replace(cell(f"{h}|{h}"), r"[%％]", "")).alias(n) for h, n in JOCKEY_RATES.items()])
    return yearly, rates, named.where(~readable).select("jockey_id", "html")


def recognise_header(texts: Column) -> dict[str, Column]:
    """Race facts recognised in a list of header texts; of several matches the later rule or text wins."""
    from raceform.functions import codes

    def has(piece: str) -> Column:
        return F.exists(texts, lambda t: t.contains(piece))

    def by_text(rules: list[tuple[str, str]]) -> Column:
        # A later text overrides an earlier one; within a text a later rule does.
        found = F.transform(texts, lambda t: F.coalesce(*[F.when(t.contains(k), F.lit(v)) for k, v in reversed(rules)]))
        return F.try_element_at(F.array_compact(found), F.lit(-1))

    def last_of(allowed: list[str]) -> Column:
        return F.try_element_at(F.filter(texts, lambda t: t.isin(*allowed)), F.lit(-1))

    metres = F.transform(F.filter(texts, lambda t: t.contains("m")), lambda t: F.regexp_extract(t, r"(\d+)", 1).try_cast("int"))
    return {
        "race_type": by_text(codes.SURFACE_RULES),
        "course_len": F.try_element_at(metres, F.lit(-1)),
        "ground_state": last_of(codes.GROUND_STATES),
        "weather": last_of(codes.HEADER_WEATHER),
        "date": F.when(has("年"), F.try_element_at(F.filter(texts, lambda t: t.contains("年")), F.lit(-1))),
        "course_type": by_text(codes.DIRECTION_RULES),
    }
