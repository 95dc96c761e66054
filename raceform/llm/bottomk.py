"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles; its sketch is the k smallest hashes. Documents with equal
sets are one class, so copies cost one row each. Inverted lists of retained values give the overlaps:

* Of the k smallest hashes of a union, those in both sets are retained by both sketches. With a similarity of
  0.75 or more, fewer than ``least_shared`` of them occur in less than one pair in 1e9 (binomial tail). Below k
  hashes in the union the count is exact.
* So two linked classes share ``least_shared`` values. Classes with too few common values have no partner. Narrow sketches
  sort those out; the rest get wide ones. Values retained by the same classes, as those of a shared passage, are one item
  with a weight, so a passage is one inverted list and not hundreds. A class lists its rarest items, as long as enough weight
  is behind them; the first item that a pair shares is on the list of both. Lists are split by size, and of those with
  equal members only the rarest is worked on, since it comes first for all its pairs.
* In each list, every member is compared with a hub, not with every other: the member whose values most others
  hold, which in a family of edited copies is the original. A pair needs enough weight of shared items. Links of a round
  are joined to components; lists whose members are not yet one component go on without their old hubs, with more new
  ones. Lists end when one component or no member is left, so no pair is missed and near-copies cost one comparison each.
  A pair is looked at in one list only, that of the rarest item it shares, so its other common lists make no rows.
* The k smallest hashes of the union estimate a pair's similarity; what passes is verified on full sets,
  recomputed from the texts.

Scale: everything is joined and grouped on values, classes or pairs, with partial aggregation; a hot
list costs one grouped minimum and a join with one row on the other side. Texts are shuffled once. Nothing is
collected to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.llm.components import components
from raceform.llm.naming import unused
from raceform.llm.shingles import WordHashes, shingle_sets
from raceform.session import counted, materialize

# Sizes of the sketch that finds classes with a possible partner, and of the one that finds the partners.
NARROW, WIDE = 48, 512
MISS = 1e-9
# Similarity of 0.75 or more, as whole numbers.
PART, WHOLE = 75, 100
# Members of one size class differ by a factor of 4/3 at most.
CLASS_RATIO = 4 / 3
ROUND_GROWTH = 16
# Low bits of an item's id that hold its weight, at most WIDE.
WEIGHT_BITS = 10
WEIGHT = (1 << WEIGHT_BITS) - 1
CLASS = ["s1", "s2", "n_shingles"]


def least_shared(k: int, miss: float = MISS) -> int:
    """Largest count such that fewer of k draws at 0.75 hit with probability below ``miss``."""
    total, count = 0.0, 0
    while (total := total + comb(k, count) * 0.75**count * 0.25 ** (k - count)) < miss:
        count += 1
    return count


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            sizes, first, second, sketches = [], [], [], []
            for found in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), hashes):
                h = found.view(np.uint64)
                sizes.append(len(h))
                first.append(int((h * (h | np.uint64(1))).sum().view(np.int64)))
                second.append(int(((h ^ (h >> np.uint64(17))) * np.uint64(0xD6E8FEB86659FD93)).sum().view(np.int64)) if len(h) else 0)
                sketches.append(found[:NARROW])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "text_id", "n_shingles", "s1", "s2", "sketch"])


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = list(shingle_sets(texts, hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([zstandard.compress(t, 3) for t in texts], pa.binary()),
                 pa.array([s[:WIDE] for s in sets], pa.list_(pa.int64()))], names=["node", "n_shingles", "body", "sketch"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both bodies to the pairs that are links on full sets."""
    hashes = WordHashes()
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist()
        keep = []
        held: dict[int, np.ndarray] = {}
        for i in range(len(a)):
            if a[i] not in held:
                held.clear()
                held[a[i]] = next(shingle_sets([zstandard.decompress(left[i])], hashes))
            x, y = held[a[i]], next(shingle_sets([zstandard.decompress(right[i])], hashes))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(WHOLE * both >= PART * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _possible(classes: DataFrame) -> DataFrame:
    """Classes with enough common values in their narrow sketch to have a partner."""
    entries = classes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1").select("value")
    return entries.join(common, "value").groupBy("node", "n_shingles").agg(F.count("*").alias("common")).where(F.col("common") >= _need(NARROW)).select("node")


def _need(k: int) -> Column:
    """Values that a set's sketch of k shares with that of any partner."""
    return F.least(F.lit(least_shared(k)), F.ceil(F.col("n_shingles") * PART / WHOLE)).cast("int")


def _members(node: Column) -> list[Column]:
    """Aggregates that together tell a set of nodes, each there once, from others: its size and two hashes, each added without carry."""
    return [F.count("*").alias("holders"), F.bit_xor(F.xxhash64(node)).alias("m0"), F.bit_xor(F.xxhash64(F.lit(1), node)).alias("m1")]


SAME = ["holders", "m0", "m1"]


def _items(bodies: DataFrame) -> DataFrame:
    """Rows (node, item) of the items before which a set can have its first common one with a partner.

    Values held by the same sets are one item, weighing as many; an item's id has its weight in the last bits. ``rarer``
    is the number of the set's rarer items, ``behind`` the weight of the others, ``items`` are all, rarest first.
    """
    entries = bodies.select("node", "n_shingles", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(*_members(F.col("node"))).where("holders > 1")
    # Values of a set move to its task once, for the items and for their order.
    held = entries.join(common, "value").repartition("node")
    held = held.groupBy("node", "n_shingles", *SAME).agg(F.count("*").alias("weight"), F.min("value").alias("least"))
    held = held.withColumn("item", F.shiftleft("least", WEIGHT_BITS).bitwiseOR(F.col("weight")))
    order = Window.partitionBy("node").orderBy("holders", "item")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = held.select(
        "node", "n_shingles", "holders", "item", (F.row_number().over(order) - 1).alias("rarer"),
        (F.sum("weight").over(whole) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")).alias("behind"),
        F.sum(F.col("weight") * F.log2("holders")).over(whole).alias("central"), F.collect_list("item").over(whole).alias("items"))
    return held.where(F.col("behind") >= _need(WIDE))


def _open(lists: DataFrame) -> DataFrame:
    """Rows of the lists with members of several components and one of its own size; of lists with equal members the rarest, where their pairs meet first."""
    of_list = lists.groupBy("list").agg(
        *_members(F.col("node")), F.min("label").alias("low"), F.max("label").alias("high"), F.max("own").alias("own"), F.min("holders").alias("h"), F.min("item").alias("item"))
    first = of_list.where("low < high and own").groupBy(*SAME).agg(F.min(F.struct("h", "item", "list")).alias("first")).select("first.list")
    return lists.join(first, "list", "left_semi")


def _enough(weight: Column, n: Column, other: Column) -> Column:
    """Whether sets of these sizes can be a link if their sketches share ``weight`` values at most."""
    return F.when(F.greatest(n, other) > WIDE, weight >= least_shared(WIDE)).otherwise((WHOLE + PART) * weight >= PART * (n + other))


def _confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (a, b) that are links: by the estimate of their sketches, then on full sets."""
    sides = [bodies.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, WIDE)
    both = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    close = pairs.join(sides[0], "a").join(sides[1], "b").where(both >= F.least(F.lit(least_shared(WIDE)), F.ceil(F.size(union) * PART / WHOLE).cast("int"))).select("a", "b")
    texts = [bodies.select(F.col("node").alias(x), F.col("body").alias(f"body_{x}")) for x in "ab"]
    return close.join(texts[1], "b").join(texts[0], "a").mapInArrow(_verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, kept says that it is the row's own. A null, empty or
    blank text has no shingles and is linked with nothing; with fewer than five words the whole sequence is the
    one shingle. Repeated rows have equal sets and are one class, kept alike; rows that repeat a doc_id with another text
    have classes of their own. Rows without doc_id follow a class that has one, else they are kept with a null
    component_id. A very long text is one row of one task, its sketches are bounded. An empty table gives an empty
    result; extra columns are not looked at.
    """
    return labelled(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` does not keep; a row goes by its doc_id and text, not by its doc_id alone."""
    doc, text_id = unused(docs, "gone_doc", "gone_text")
    gone = labelled(docs).where("doc_id != component_id or doc_id is null and component_id is not null")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("text_id").alias(text_id)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_id)), "left_anti")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, n_shingles, component_id); text_id is the hash of the row's text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    rows = materialize(rows.mapInArrow(_sketch, "doc_id bigint, text_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sketch array<bigint>"), "sketches")
    # Nodes are numbers of classes, pinned by writing them.
    leader = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_id"))).alias("lead")
    classes = rows.where("n_shingles > 0").groupBy(*CLASS).agg(leader, F.any_value("sketch").alias("sketch")).where("lead is not null")
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), *CLASS, "lead.*", "sketch"), "sketch-classes")
    possible = classes.join(_possible(classes), "node", "left_semi").select("node", "doc_id", "text_id")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text").join(possible, ["doc_id", "text_id"])
    bodies = texts.select("node", "text").mapInArrow(_widen, "node bigint, n_shingles bigint, body binary, sketch array<bigint>")
    # Repeated rows of a document are one body.
    bodies = materialize(bodies.dropDuplicates(["node"]), "bodies")
    step = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(CLASS_RATIO)) + 1e-9)
    alive = _items(bodies).withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    alive = alive.withColumns({"list": F.xxhash64("item", F.when(F.col("own"), step).otherwise(step + 1)), "label": F.col("node")})
    alive = materialize(alive, "items")
    # Lists are narrow; the items of a set are read where pairs are made.
    items = alive.where("own and rarer = 0").select("node", "items")
    alive, left = counted(_open(alive.drop("items")), "lists")

    labels: DataFrame | None = None
    hubs_per_list = 1
    while left:
        salted = alive.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(hubs_per_list)), F.lit(hubs_per_list)))
        hubs = salted.groupBy("list", "salt").agg(F.min(F.struct(
            (-F.col("central")).alias("rest"), F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("n_shingles").alias("hub_n"),
            F.col("behind").alias("hub_behind"), F.col("rarer").alias("hub_rarer"), F.col("own").alias("hub_own"))).alias("h"))
        hubs = materialize(hubs.select("list", "h.*"), "hubs")
        # A pair meets in one list, that of the rarest item it shares and of the larger one's size. Behind that item there is enough
        # weight on both sides, and what they share is enough.
        n, hub_n = F.col("n_shingles"), F.col("hub_n")
        met = F.arrays_overlap(F.slice("items", F.lit(1), F.col("rarer")), F.slice("hub_items", F.lit(1), F.col("hub_rarer")))
        overlap = F.aggregate(F.array_intersect("items", "hub_items"), F.lit(0).cast("bigint"), lambda total, item: total + item.bitwiseAND(WEIGHT))
        fits = (
            (F.col("label") != F.col("hub_label")) & (WHOLE * F.least(n, hub_n) >= PART * F.greatest(n, hub_n))
            & (F.col("own") | F.col("hub_own")) & _enough(F.least("behind", "hub_behind"), n, hub_n) & ~met & _enough(overlap, n, hub_n)
        )
        members = alive.select("list", "node", "label", "n_shingles", "rarer", "behind", "own").join(items, "node")
        centres = hubs.join(items.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")), "hub")
        pairs = members.join(centres, (members["list"] == centres["list"]) & fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs, met_now = counted(pairs, "pairs")
        confirmed, new = counted(_confirmed(pairs, bodies), "links") if met_now else (None, 0)
        alive = alive.join(hubs.select(F.col("hub").alias("node"), "list"), ["node", "list"], "left_anti")
        if new:
            links = confirmed.select(F.col("a").alias("u"), F.col("b").alias("v"))
            labels = components(links if labels is None else labels.unionByName(links))
            found = labels.select(F.col("u").alias("node"), F.col("v").alias("found"))
            alive = alive.join(found, "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")
        alive, left = counted(_open(alive), "lists")
        hubs_per_list *= ROUND_GROWTH

    ids = classes.select("node", F.col("doc_id").alias("smallest"))
    if labels is not None:
        members = labels.select(F.col("u").alias("node"), "v").unionByName(labels.select(F.col("v").alias("node"), "v").distinct())
        of_component = members.join(ids, "node").groupBy("v").agg(F.min("smallest").alias("component"))
        ids = ids.join(members.join(of_component, "v").select("node", "component"), "node", "left").withColumn("smallest", F.coalesce("component", "smallest"))
    out = rows.select("doc_id", "text_id", *CLASS).join(classes.select(*CLASS, "node").join(ids, "node").select(*CLASS, "smallest"), CLASS, "left")
    return out.select("doc_id", "text_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))
