"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (line hash, documents, largest document), sorted by hash inside hash partitions. Each
batch of documents is aggregated to one such table and merge-anti-joined with the runs: a line that they
already know to be frequent, with a document at least as large, tells nothing new and is left out; the rest
becomes a run of level 0. When a level has ``FANOUT`` runs they are merged into one of the next level, so
a batch meets few runs and every row is rewritten once per level. A later load adds its batches to the
same store.

Scale: lines are exploded once, as 128-bit hashes without their text. Hot lines are aggregated on the map
side before every shuffle, and the join of lines with frequent hashes has one row per hash on its small side,
so a skewed partition of lines can be split. Texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.llm.naming import unused
from raceform.session import materialize

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs in the shared folder; ``levels[i]`` are the runs of level i."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def merged(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return self._sum(every) if len(runs) > 1 else every

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"))

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2, doc_id), a row per document and line; no document may be in two batches."""
        rows = batch.select(*HASH, "doc_id").distinct().groupBy(*HASH).agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("largest"))
        known = self.merged()
        if known is not None:
            settled = known.where(F.col("docs") >= self.min_docs).select(*HASH, F.col("largest").alias("known"))
            rows = rows.join(settled, [rows[h] == settled[h] for h in HASH] + [settled["known"] >= F.coalesce(rows["largest"], F.lit(-(2**63)))], "left_anti")
        self._put(0, rows)

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(materialize(rows.sortWithinPartitions(*HASH), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            every = runs[0]
            for run in runs[1:]:
                every = every.unionByName(run)
            self._put(level + 1, self._sum(every))

    def frequent(self) -> DataFrame:
        """(h1, h2, largest) of the lines found in at least ``min_docs`` documents."""
        return self.merged().where(F.col("docs") >= self.min_docs).select(*HASH, "largest")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with ``kept`` (text without the repeated lines), ``n_lines`` and ``n_dropped``.

    Lines end at a line feed only. A line counts by its key: without ASCII space at both ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents keep their lines in the
    largest doc_id holding them only. A null or empty text is one empty line, and ``kept`` is then empty. Rows
    without doc_id do not count as documents, but lose frequent lines; repeated rows of a doc_id are one
    document, and each keeps or loses its own lines. An empty table gives an empty result. Extra columns pass
    through; those named like a result are replaced.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, min_docs)
    key = line_key(F.col("line"))
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("line", key).where(F.char_length("line") >= min_chars)
        .select("doc_id", "text_id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    )
    lines = materialize(lines, "lines")
    for number in range(batches):
        runs.add(lines.where(F.col("batch") == number))
    doc, text_id, drop = unused(docs, "drop_doc", "drop_text", "drop_lines")
    drops = (
        lines.join(runs.frequent(), HASH).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("largest")))
        .groupBy(F.col("doc_id").alias(doc), F.col("text_id").alias(text_id)).agg(F.collect_set("pos").alias(drop))
    )
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_id)), "left").drop(doc, text_id)
    split = text_lines(F.col("text"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), drop), lambda i: F.get(split, i)), "\n")
    return joined.withColumns({
        "kept": F.when(F.col(drop).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept),
        "n_lines": F.size(split).cast("bigint"),
        "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("bigint"),
    }).drop(drop)
