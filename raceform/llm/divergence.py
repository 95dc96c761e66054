"""Divergence of sources by their terms: which sources of a language differ, and by which terms.

Method: each task handles one unordered pair of sources of a language over one slice of the vocabulary. It cogroups the sorted
(term id, count) arrays of both; a galloping intersection finds the terms of both, the rest of either is one-sided, and
the terms of neither are priced by their number. One pass prices the pair both ways; slices are summed.

Scale: terms are counted where texts are read, in tables of bounded size per task, then summed by (language, source, term). The vocabulary
of a language is dealt into slices by hash, as many as it needs, and term ids are numbers inside a slice. So a task holds two
arrays of some ``SLICE_TERMS`` entries, whatever a source's or a language's size. Pairs of sources are what the result
holds, a row for each direction; documents or terms are never paired. Nothing goes to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.session import materialize

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
SLICE_TERMS = 1 << 15
# Distinct terms that a task gathers before it hands them on, and bytes of a text that are split at once.
HELD_TERMS = 1 << 19
PIECE = 1 << 20
GALLOP = 1 << 10
BROADCAST_ROWS = 50_000
# Letters and bytes of other scripts stay, A-Z lower-cased; all else is space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of bounded size unless one term is longer."""
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            n_terms = len(counts)
            columns = [pa.array(list(counts), pa.binary()), *(pa.array(np.fromiter(n, np.int64, n_terms)) for n in (counts.values(), map(docs.__getitem__, counts)))]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, n_terms), pa.repeat(source, n_terms), *columns], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for text, lang, source in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            own: set[bytes] = set()
            for terms in pieces(text.as_py()):
                counts.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(counts)
            if size > HELD_TERMS:
                yield from rows()
                size = 0
    yield from rows()


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + kept)), exact: three digits at a time."""
    whole = total + kept
    rest = counts + 1 if whole < 1 << 52 else counts.astype(object) + 1
    found = rest // whole
    rest = rest - found * whole
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return (found + 1).astype(np.int64)


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each id of ``short`` stands in ``long``, -1 where it doesn't; both sorted. Each run of ids doubles its stride from where the last one ended."""
    found = np.full(len(short), -1, np.int64)
    low = 0
    for start in range(0, len(short), GALLOP):
        run = short[start : start + GALLOP]
        stride = GALLOP
        while low + stride < len(long) and long[low + stride] < run[-1]:
            stride *= 2
        window = long[low : low + stride + 1]
        at = np.searchsorted(window, run)
        same = at < len(window)
        same[same] = window[at[same]] == run[same]
        found[start : start + GALLOP][same] = at[same] + low
        low += int(at[-1])
    return found


def price_pair(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int, kept: int) -> tuple[int, int]:
    """Both divergences over a slice of ``terms`` terms; a and b: sorted ids, their counts, and the source's total; ``kept``: terms of the language."""
    (ids_a, n_a, total_a), (ids_b, n_b, total_b) = a, b
    if len(ids_a) > len(ids_b):
        return price_pair(b, a, terms, kept)[::-1]
    at = gallop(ids_a, ids_b)
    both = at >= 0
    others = np.ones(len(ids_b), bool)
    others[at[both]] = False
    none = np.zeros(1, np.int64)
    p, q = shares(n_a, total_a, kept), shares(n_b, total_b, kept)
    p0, q0 = shares(none, total_a, kept), shares(none, total_b, kept)
    absent = terms - len(ids_a) - int(others.sum())
    sides = []
    for price in (prices, lambda x, y: prices(y, x)):
        sides.append(int(price(p[both], q[at[both]]).sum()) + int(price(p[~both], q0).sum()) + int(price(p0, q[others]).sum()) + absent * int(price(p0, q0)[0]))
    return sides[0], sides[1]


def _task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    x, y = a.iloc[0], b.iloc[0]
    side = lambda r: (np.asarray(r["ids"], np.int64), np.asarray(r["counts"], np.int64), int(r["total"]))
    forth, back = price_pair(side(x), side(y), int(x["terms"]), int(x["kept"]))
    return pd.DataFrame({"lang": x["lang"], "source": [x["a"], x["b"]], "item": [x["b"], x["a"]], "value": [forth, back]})


def exact_share(n: Column, total: Column, kept: Column) -> Column:
    return F.expr("1L") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kept).cast("decimal(20,0)"))


def ranked(rows: DataFrame, top: int | None = None, *more: str) -> DataFrame:
    order = Window.partitionBy("lang", "source", *more).orderBy(F.desc("value"), F.col("item"))
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if top is None else rows.where(F.col("rank") <= top)


def small(rows: DataFrame) -> DataFrame:
    """Stored rows, to be broadcast if there are few; else Spark joins them by their key."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from each other one (part ``pair``) and from the language (``term``).

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in at least ``min_docs`` of its
    documents. Shares of terms are in billionths, smoothed by one, and a term's value is the squared difference over the other
    share; all arithmetic is in whole numbers. Of the terms that a source has more of than its language, the ``top_terms``
    with the largest values are returned.

    Null text, lang and source count as empty text. A source without kept terms still has its pairs. Every row is a document, repeated
    rows and rows without doc_id too. Long texts are split piece by piece. Equal values are ranked by item. An empty table gives an
    empty result; other columns are not looked at, whatever their names.
    """
    empty = F.lit("")
    docs = docs.select(*[F.coalesce(c, empty).alias(c) for c in ("text", "lang", "source")])
    counted = docs.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialize(counts, "term-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    vocabulary = materialize(vocabulary.select("lang", "term", "lang_n"), "terms")
    of_lang = small(materialize(vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "languages"))
    slices = F.ceil(F.col("kept") / slice_terms).cast("long")
    number = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term"))
    vocabulary = vocabulary.join(of_lang, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), slices))
    vocabulary = materialize(vocabulary.repartition("lang", "slice").withColumn("id", number).select("lang", "term", "lang_n", "slice", "id"), "term-ids")
    entries = counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"])
    entries = materialize(entries, "term-entries")

    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = materialize(groups, "sources")
    arrays = entries.groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("held"))
    of_slice = vocabulary.groupBy("lang", "slice").agg(F.count("*").alias("terms"))
    arrays = groups.join(of_slice, "lang").join(arrays, ["lang", "source", "slice"], "left").select(
        "lang", "source", "slice", "terms", "kept", "total", F.coalesce("held.id", F.array().cast("array<int>")).alias("ids"), F.coalesce("held.n", F.array().cast("array<bigint>")).alias("counts"))
    arrays = materialize(arrays, "term-arrays")
    one, other = groups.select("lang", F.col("source").alias("a")), groups.select("lang", F.col("source").alias("b"))
    pairs = one.join(other, "lang").where("a < b")
    key = ["lang", "a", "b", "slice"]
    sides = [pairs.join(arrays.withColumnRenamed("source", side), ["lang", side]) for side in ("a", "b")]
    # Names of their own, as both sides come from one table.
    sides = [side.select(*[F.col(c).alias(c) for c in side.columns]).groupBy(*key) for side in sides]
    priced = sides[0].cogroup(sides[1]).applyInPandas(_task, "lang string, source string, item string, value long")
    without = groups.where("kept = 0")
    unpriced = without.select("lang", "source").join(without.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pair = priced.unionByName(unpriced.withColumn("value", F.lit(0).cast("long"))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = exact_share(F.col("n"), F.col("total"), F.col("kept")), exact_share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = entries.join(small(groups), ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    terms = terms.select("lang", "source", "slice", F.col("term").cast("string").alias("item"), value.alias("value"))
    terms = ranked(ranked(terms, top_terms, "slice").drop("rank", "slice"), top_terms)
    out = ("lang", "source", "part", "item", "value", "rank")
    return ranked(pair).withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))
