"""Mix sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every source's documents are put in a keyed random order, laid end to end and cut into blocks of
equally many words. Slot ``i`` of the schedule is the golden-ratio point ``frac((i + 1/2) * G)``, and the
interval of cumulative target weights it falls into names its source, so that any stretch of the
mix holds every source in nearly its share. The slots of one source are ranked, and rank ``r`` takes
block ``r mod blocks`` in pass ``r div blocks``. A closing step settles each source on its target: slots
beyond it go, the last one is cut short, and the few that discrepancy left out are appended.

Scale: texts are read once, for their sizes. Hot sources are split everywhere: running sums and ranks
are taken inside (source, hash prefix) and (source, slot chunk), and only one row for each of those goes
through a window per source. Points meet sources through cells of the unit interval, an equi-join. The
only window without a partition runs over one row per source.
"""

from __future__ import annotations

from decimal import Decimal, getcontext
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
# Largest block, and blocks that an average source has at least.
BLOCK_WORDS = 4096
BLOCKS_PER_SOURCE = 1024
# Documents in one stretch of a source, slots in one stretch of the schedule, cells of the unit interval.
STRETCH_DOCS = 50_000
STRETCH_SLOTS = 1 << 20
CELLS = 4096

getcontext().prec = 40
GOLDEN = (Decimal(5).sqrt() - 1) / 2
HIGH_BITS = 20


class Mix(NamedTuple):
    documents: DataFrame  # one row per row of the input: doc_id, size, source_size, target, taken
    pieces: DataFrame  # the mix in order of slot: slot, source, doc_id, from_word, n_words
    sources: DataFrame  # source, source_size, target, words, blocks, block_words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Words each source is to give: 150 % of all words by weight, at most twice what the source has.

    The capped sources are those with the least words per weight; with sources in that order, one is
    capped if its share of what the ones before leave over reaches its cap. All sums are of whole numbers.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    total, none = Window.partitionBy(), F.lit(0).cast("bigint")
    wide = lambda c: c.cast("decimal(38,0)")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("bigint"))
        .withColumn("rest", 3 * F.sum("source_size").over(total) - 4 * F.coalesce(F.sum("source_size").over(before), none))
        .withColumn("open", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), none))
        .withColumn("capped", wide(F.col("weight")) * wide(F.col("rest")) >= wide(4 * F.col("source_size")) * wide(F.col("open")))
        .withColumn("last", F.max(F.when(F.col("capped"), -F.col("open"))).over(total))
        .withColumn("capped", F.coalesce(-F.col("open") <= F.col("last"), F.lit(False)))
        .withColumn("share", F.first(F.when(~F.col("capped"), F.struct("rest", "open")), ignorenulls=True).over(
            Window.orderBy((-F.col("open"))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.when(F.col("capped"), (2 * F.col("source_size")).cast("double")).otherwise(
            (F.col("weight") * F.col("share.rest")).cast("double") / (2 * F.col("share.open")).cast("double")).alias("target"))
    )


def _running(df: DataFrame, keys: list[str], stretch: str, value: str) -> DataFrame:
    """Sum of ``value`` over all earlier stretches of the same keys, one row per key and stretch."""
    order = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*keys, stretch).agg(F.sum(value).alias("inside")).select(
        *keys, stretch, F.coalesce(F.sum("inside").over(order), F.lit(0)).cast("bigint").alias("earlier"))


def mix(docs: DataFrame, seed: str = "", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> Mix:
    """Mix ``docs`` (doc_id, text, source).

    A null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
    a null doc_id is an ordinary document; repeated rows are separate documents with equal places in the
    order, so reruns agree. An empty table gives empty results. Other columns are not looked at.
    """
    spark = docs.sparkSession
    read = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("shuffle"))
    # A null source gets an empty key that no named source has.
    read = materialize(read.withColumn("key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source"))), "mix-sizes")
    n_docs, n_words, n_sources = read.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("key")).first()
    block = min(block_words, max(1, 3 * n_words // 2 // (BLOCKS_PER_SOURCE * max(1, n_sources))))
    slots = -(-3 * n_words // (2 * block))
    digits, room = 0, STRETCH_DOCS
    while room < n_docs:
        digits, room = digits + 1, room * 16

    sources = (
        source_targets(read.select("source", "size"), weights)
        .withColumn("key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source")))
        .withColumn("words", F.floor("target"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("block_words", F.lit(block).cast("bigint"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("bigint"))
        .withColumn("over", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("ranks", F.col("passes") * F.col("blocks") + F.ceil(F.col("over") / block))
    )
    sources = materialize(sources, "mix-sources")

    stretch = read.withColumn("stretch", F.substring("shuffle", 1, digits))
    inside = Window.partitionBy("key", "stretch").orderBy("shuffle", "doc_id", "size")
    placed = (
        stretch.withColumn("nth", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(_running(stretch, ["key"], "stretch", "size"), ["key", "stretch"])
        .withColumn("start", F.col("earlier") + F.col("upto") - F.col("size"))
    )
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
        .withColumn("low", F.greatest("start", F.col("block") * block))
        .withColumn("high", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    )

    taken = _schedule(sources, slots).join(sources.select("key", "source_size", "blocks", "passes", "over"), "key")
    taken = (
        taken.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
        .withColumn("until", F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("over")))
        .select("key", "block", "slot", "until")
    )
    pieces = (
        pieces.join(taken, ["key", "block"]).withColumn("n_words", F.least("high", "until") - F.col("low")).where("n_words > 0")
        .select("slot", "source", "key", "stretch", "nth", "doc_id", (F.col("low") - F.col("start")).alias("from_word"), "n_words")
    )
    sums = pieces.groupBy("key", "stretch", "nth").agg(F.sum("n_words").alias("taken"))
    documents = (
        placed.join(sums, ["key", "stretch", "nth"], "left").join(sources.select("key", "source_size", "target"), "key")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )
    return Mix(documents, pieces.drop("key", "stretch", "nth"), sources.select("source", "source_size", "target", "words", "blocks", "block_words"))


def _schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, key, rank): the schedule, settled on the number of blocks each source is to give."""
    spark = sources.sparkSession
    step, high = float(GOLDEN), float(GOLDEN * (1 << HIGH_BITS) % 1)
    point = F.pmod((F.expr(f"slot % {1 << HIGH_BITS}") + 0.5) * step + F.expr(f"slot div {1 << HIGH_BITS}") * high, F.lit(1.0))
    upto = F.sum("target").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    all_words = F.sum("target").over(Window.partitionBy())
    spans = (
        sources.where("ranks > 0").withColumn("to", upto / all_words).withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("key")), F.lit(0.0)))
        .select("key", "from", "to", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.least(F.floor(F.col("to") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    )
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = points.join(spans, "cell").where("point >= from and point < to").select("slot", "key", F.expr(f"slot div {STRETCH_SLOTS}").alias("chunk"), F.lit(1).alias("one"))
    ranked = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot"))).join(
        _running(drawn, ["key"], "chunk", "one"), ["key", "chunk"]).select("slot", "key", (F.col("earlier") + F.col("nth") - 1).alias("rank"))
    drawn_ranks = sources.select("key", "ranks").join(drawn.groupBy("key").agg(F.count("*").alias("drawn")), "key", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    appended = (
        drawn_ranks.where("drawn < ranks").select("key", F.explode(F.expr("sequence(drawn, ranks - 1)")).alias("rank"), "drawn")
        .select((F.col("rank") - F.col("drawn") + slots).alias("slot"), "key", "rank")
    )
    return ranked.join(drawn_ranks.select("key", "ranks"), "key").where("rank < ranks").select("slot", "key", "rank").unionByName(appended)
