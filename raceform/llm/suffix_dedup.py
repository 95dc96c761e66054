"""Removal of repeated byte strings, by suffix arrays sorted deep-shallow.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier in the corpus. Equal strings must meet in
one sort, although no task can hold the corpus. They do so by content: of the ``GRAM``-byte grams inside a string the
one with the smallest hash (the leftmost of equals) is its anchor, and equal strings have equal anchors. Neighbouring
strings mostly share an anchor, so a shard's strings come as runs: an anchor with some bytes around it.

1. Documents are packed into shards, compressed, and stored with the anchors of their runs.
2. Anchors are dealt by hash and counted: which occur in several shards, which have more different runs than a bucket should hold.
3. Each shard looks at its runs with such anchors or with anchors repeated inside it. Of runs with equal bytes all but
   the earliest are repeats as a whole and end here; the earliest is sent to the bucket of its anchor. Runs of anchors
   with too many are sent string by string, each to the bucket of its own bytes, so that no bucket is hot.
4. A bucket again settles runs with equal bytes, sorts the strings of the rest as suffixes of their concatenation
   (`suffix_sort.deep_shallow`), and tells the shards which strings start earlier elsewhere.
5. Each shard removes what repeated strings cover.

Scale: a task holds one shard or one bucket, whose number grows with the corpus; a passage that is everywhere
costs a shard one run. Compressed texts are shuffled twice; nothing is broadcast or collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceform.llm.suffix_sort import deep_shallow
from raceform.session import materialize

LENGTH = 100
GRAM = 24
WINDOW = LENGTH - GRAM + 1
SHARD_BYTES = 4 << 20
BUCKET_RUNS = 300_000
# A bucket is dealt whole anchors, so that one anchor may have a sixth of its runs at most.
HOT_RUNS = BUCKET_RUNS // 6
CHUNK = 1 << 17
POSITION_BITS = 18
FIRST_DOC = -(2**63)
POLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
LEVEL = 6
# Anchors are counted by so many of their bits; chance agreements cost work, not correctness.
COUNTED_BITS = 48


def _anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string of LENGTH bytes in ``text``: the place of its anchor and the anchor's hash; worked off in chunks."""
    n = len(text) - LENGTH + 1
    place, value = np.empty(max(0, n), np.int64), np.empty(max(0, n), np.uint64)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    with np.errstate(over="ignore"):
        for low in range(0, n, CHUNK):
            m = min(CHUNK, n - low)
            h = text[low : low + m + LENGTH - 1].astype(np.uint64) + np.uint64(1)
            for step, factor in zip((1, 2, 4, 8), POLY, strict=False):
                h = h[:-step] * factor + h[step:]
                if step == 4:
                    eight = h
            h = h[:-8] * POLY[4] + eight[16:]  # GRAM = 16 + 8
            h ^= h >> np.uint64(29)
            h *= POLY[1]
            key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
            wide = 1
            while wide * 2 <= WINDOW:
                key = np.minimum(key[:-wide], key[wide:])
                wide *= 2
            key = np.minimum(key[: len(key) - (WINDOW - wide)], key[WINDOW - wide :])
            at = (key & mask).astype(np.int64)
            place[low : low + m] = at + low
            value[low : low + m] = h[at]
    return place, value


def _runs(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first string, string after the last, hash) of strings with one anchor; documents stand one byte apart."""
    place, value = _anchors(text)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    inside = np.zeros(len(place) + 1, np.int8)
    long = sizes >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, begins[long] + sizes[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.append(True, place[1:] != place[:-1]) if len(place) else np.empty(0, bool)
    new[begins[long]] = True
    first = np.flatnonzero(new & inside)
    edge = np.flatnonzero(np.append(new | ~inside, True))
    last = edge[np.searchsorted(edge, first, "right")]
    return first, last, value[first]


def _squeeze(values: np.ndarray) -> bytes:
    """A packed array, as differences."""
    return zstandard.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes(), LEVEL)


def _unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), kind), dtype=kind)


def _counted(values: np.ndarray) -> np.ndarray:
    return values >> np.uint64(64 - COUNTED_BITS)


def _held(body: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counted anchors of a shard, sorted, and for each how many of its runs differ."""
    first, last, value = _runs(np.frombuffer(body, np.uint8), sizes)
    values, number, counts = np.unique(_counted(value), return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[number] > 1)
    spans = zip(number[several].tolist(), first[several].tolist(), last[several].tolist(), strict=True)
    different = {(n, xxhash.xxh3_128_digest(body[a : b + LENGTH - 1])) for n, a, b in spans}
    counts[counts > 1] = 0
    np.add.at(counts, np.array([n for n, _ in different], np.int64), 1)
    return values, counts.astype(np.uint32)


def _concatenated(texts: list[bytes]) -> bytes:
    return b"\0".join(texts) + b"\0"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is not None, docs[i]))
        while order:
            taken, held = 0, 0
            while taken < len(order) and (not taken or held + len(texts[order[taken]]) <= SHARD_BYTES):
                held += len(texts[order[taken]])
                taken += 1
            mine, order = order[:taken], order[taken:]
            body = _concatenated([texts[i] for i in mine])
            sizes = np.array([len(texts[i]) for i in mine], np.int64)
            values, counts = _held(body, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([[docs[i] for i in mine]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([zstandard.compress(body, LEVEL)], pa.binary()), pa.array([int(counts.sum())], pa.int64()), pa.array([_squeeze(values)], pa.binary()), pa.array([_squeeze(counts)], pa.binary())],
                names=["shard", "docs", "sizes", "body", "n_runs", "anchors", "runs"])
            number += 1


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob, runs in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchors", "runs")), strict=True):
                values, counts = _unsqueeze(blob, np.uint64), _unsqueeze(runs, np.uint32)
                bucket = (values % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                values, counts, bucket = values[order], counts[order], bucket[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
                parts, sums = (np.split(x, cuts[1:]) if len(cuts) else [] for x in (values, counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts], pa.int64()), pa.array([shard] * len(cuts), pa.int64()), pa.array([_squeeze(p) for p in parts], pa.binary()), pa.array([_squeeze(p) for p in sums], pa.binary())],
                    names=["bucket", "shard", "anchors", "runs"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """Anchors of one bucket to, for each shard, those that other shards have too, and those with too many runs."""
    shards = table.column("shard").to_pylist()
    parts = [_unsqueeze(b, np.uint64) for b in table.column("anchors").to_pylist()]
    runs = np.concatenate([_unsqueeze(b, np.uint32) for b in table.column("runs").to_pylist()])
    known, number, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared, hot = known[counts > 1], known[np.bincount(number, runs, len(known)) > HOT_RUNS]
    rows = [(s, _squeeze(np.intersect1d(p, shared, assume_unique=True)), _squeeze(np.intersect1d(p, hot, assume_unique=True))) for s, p in zip(shards, parts, strict=True)]
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "shared": pa.array([r[1] for r in rows], pa.binary()), "hot": pa.array([r[2] for r in rows], pa.binary())})


def _is_in(values: np.ndarray, blobs: list[bytes] | None) -> np.ndarray:
    known = [_unsqueeze(b, np.uint64) for b in blobs or []]
    return np.isin(_counted(values), np.concatenate([np.empty(0, np.uint64), *known]))


# A shard's strings for one bucket: packed numbers, compressed bytes. What a shard has found itself travels along.
SENT = "bucket bigint, shard bigint, doc binary, start binary, size binary, anchor binary, body binary, found binary"


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _send_shard(row, buckets)

    return run


def _send_shard(row: dict, buckets: int) -> pa.RecordBatch:
    body = zstandard.decompress(row["body"])
    sizes = np.array(row["sizes"], np.int64)
    docs = np.array([FIRST_DOC if d is None else d for d in row["docs"]], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    first, last, value = _runs(np.frombuffer(body, np.uint8), sizes)
    _, number, counts = np.unique(value, return_inverse=True, return_counts=True)
    shared, hot = _is_in(value, row["shared"]), _is_in(value, row["hot"])
    chosen = np.flatnonzero(shared | (counts[number] > 1))
    # Hot runs string by string.
    warm = chosen[~hot[chosen]]
    burnt = chosen[hot[chosen]]
    n = last[burnt] - first[burnt]
    single = np.repeat(first[burnt] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum()) if len(burnt) else np.empty(0, np.int64)
    low = np.concatenate([first[warm], single])
    high = np.concatenate([last[warm], single + 1])
    anchor = np.concatenate([value[warm], np.zeros(len(single), np.uint64)])
    elsewhere = np.concatenate([shared[warm], np.ones(len(single), bool)])
    order = np.argsort(low, kind="stable")
    low, high, anchor, elsewhere = low[order], high[order], anchor[order], elsewhere[order]
    alone = np.concatenate([np.zeros(len(warm), bool), np.ones(len(single), bool)])[order]

    seen: dict[bytes, int] = {}
    keep = np.zeros(len(low), bool)
    for i, (a, b, one) in enumerate(zip(low.tolist(), high.tolist(), alone.tolist(), strict=True)):
        text = body[a : b + LENGTH - 1]
        if seen.setdefault(text, i) == i:
            keep[i] = True
            if one:
                anchor[i] = _text_hash(text)
    found = np.stack([low[~keep], high[~keep]])
    _, number, counts = np.unique(anchor[keep], return_inverse=True, return_counts=True)
    sent = np.flatnonzero(keep)[elsewhere[keep] | (counts[number] > 1)] if len(low) else np.empty(0, np.int64)
    low, high, anchor = low[sent], high[sent], anchor[sent]
    bucket = (anchor % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    low, high, anchor, bucket = low[order], high[order], anchor[order], bucket[order]
    doc = docs[np.searchsorted(begins, low, "right") - 1]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(cuts, len(bucket))[1:]
    out = [(row["shard"] % buckets, row["shard"], None, None, None, None, None, found.astype(np.int64).tobytes())] if found.shape[1] else []
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        texts = b"".join([body[x : y + LENGTH - 1] for x, y in zip(low[a:b].tolist(), high[a:b].tolist(), strict=True)])
        out.append((int(bucket[a]), row["shard"], _squeeze(doc[a:b]), _squeeze(low[a:b]), zstandard.compress((high[a:b] - low[a:b]).astype(np.uint8).tobytes(), LEVEL),
                    (anchor[a:b] >> np.uint64(32)).astype(np.uint32).tobytes(), zstandard.compress(texts, LEVEL), None))
    kinds = [pa.int64()] * 2 + [pa.binary()] * 6
    names = ["bucket", "shard", "doc", "start", "size", "anchor", "body", "found"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)


def _text_hash(text: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(text))


def _sort(table: pa.Table) -> pa.Table:
    """One bucket: which of its strings start earlier in another run or another shard."""
    every = table.select(["shard", "doc", "start", "size", "anchor", "body", "found"]).to_pylist()
    rows = [r for r in every if r["body"] is not None]
    told = [(r["shard"], r["found"]) for r in every if r["body"] is None]
    none = np.empty(0, np.int64)
    doc, start = (np.concatenate([none, *(_unsqueeze(r[c], np.int64) for r in rows)]) for c in ("doc", "start"))
    sizes = [np.frombuffer(zstandard.decompress(r["size"]), np.uint8) for r in rows]
    size = np.concatenate([none, *sizes])
    shard = np.concatenate([none, *(np.full(len(s), r["shard"]) for s, r in zip(sizes, rows, strict=True))])
    anchor = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(r["anchor"], np.uint32) for r in rows)])
    body = b"".join(zstandard.decompress(r["body"]) for r in rows)
    end = np.cumsum(size + LENGTH - 1)
    begin = end - size - LENGTH + 1
    age = np.empty(len(doc), np.int64)
    by_age = np.lexsort((start, shard, doc))
    age[by_age] = np.arange(len(doc))

    seen: dict[bytes, int] = {}
    whole = np.zeros(len(doc), bool)
    for i in by_age.tolist():
        whole[i] = seen.setdefault(body[begin[i] : end[i]], i) != i
    del seen
    found = [np.stack([shard[whole], start[whole], start[whole] + size[whole]])]
    rest = np.flatnonzero(~whole)
    _, number, counts = np.unique(anchor[rest], return_inverse=True, return_counts=True)
    rest, number = rest[counts[number] > 1], number[counts[number] > 1]
    if len(rest):
        # Strings with the same anchor are equal only if it stands at the same place in them.
        of = np.repeat(np.arange(len(rest)), size[rest])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size[rest]) - size[rest], size[rest])
        text = np.frombuffer(body, np.uint8)
        order, equal = deep_shallow(text, begin[rest][of] + nth, number[of], LENGTH)
        head = np.flatnonzero(~equal)
        oldest = np.minimum.reduceat(age[rest][of][order], head)
        later = age[rest][of][order] > np.repeat(oldest, np.diff(np.append(head, len(order))))
        hits = np.sort(order[later])
        at = start[rest][of[hits]] + nth[hits]
        found.append(np.stack([shard[rest][of[hits]], at, at + 1]))
    out = np.concatenate(found, axis=1)
    out = out[:, np.lexsort((out[1], out[0]))]
    joined = _join(out)
    shards, cuts = np.unique(joined[0], return_index=True)
    parts = np.split(joined[1:], cuts[1:], axis=1) if len(cuts) else []
    told += [(s, np.ascontiguousarray(p).tobytes()) for s, p in zip(shards.tolist(), parts, strict=True)]
    return pa.table({"shard": pa.array([t[0] for t in told], pa.int64()), "found": pa.array([t[1] for t in told], pa.binary())})


def _join(spans: np.ndarray) -> np.ndarray:
    """Sorted spans (shard, from, to), those that touch made one."""
    if not spans.shape[1]:
        return spans
    reach = np.maximum.accumulate(np.where(True, spans[2], 0)) if len(np.unique(spans[0])) == 1 else None
    if reach is None:
        parts = np.split(spans, np.flatnonzero(spans[0][1:] != spans[0][:-1]) + 1, axis=1)
        return np.concatenate([_join(p) for p in parts], axis=1)
    new = np.append(True, spans[1][1:] > reach[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, spans.shape[1] - 1)
    return np.stack([spans[0][new], spans[1][new], reach[ends]])


SPANS = "array<struct<start:bigint,end:bigint>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for row in batch.to_pylist():
            body, sizes = zstandard.decompress(row["body"]), np.array(row["sizes"], np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes + 1)])
            found = [np.frombuffer(b, np.int64).reshape(2, -1) for b in row["found"] or []]
            spans = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            spans = np.stack([np.zeros(spans.shape[1], np.int64), spans[0], spans[1] + LENGTH - 1])
            spans = _join(spans[:, np.argsort(spans[1], kind="stable")])[1:]
            cut = np.searchsorted(spans[0], begins)
            kept, removed = [], []
            for i, size in enumerate(sizes.tolist()):
                at, base, parts, gone = 0, int(begins[i]), [], []
                for a, b in spans[:, cut[i] : cut[i + 1]].T.tolist():
                    parts.append(body[base + at : a])
                    gone.append({"start": a - base, "end": b - base})
                    at = b - base
                kept.append(b"".join([*parts, body[base + at : base + size]]))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept), one row for each row of ``docs`` (doc_id, text).

    ``removed`` are the maximal removed spans of the UTF-8 bytes, ``kept`` are the other bytes. Strings are judged on
    the input and never reach over documents; earlier means a smaller doc_id, or an earlier start in the same one. A null
    text is empty; texts shorter than LENGTH bytes stay whole. Rows without doc_id come first; of rows that repeat a
    doc_id, one (fixed by the stored shards) is the earlier. An empty table gives an empty result; extra columns
    are not looked at.
    """
    spark = docs.sparkSession
    shards = docs.select("doc_id", "text").mapInArrow(_pack, "shard bigint, docs array<bigint>, sizes array<bigint>, body binary, n_runs bigint, anchors binary, runs binary")
    shards = materialize(shards, "shards")
    total = shards.agg(F.coalesce(F.sum("n_runs"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_RUNS))
    dealt = shards.select("shard", "anchors", "runs").mapInArrow(_deal(buckets), "bucket bigint, shard bigint, anchors binary, runs binary")
    counted = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count, "shard bigint, shared binary, hot binary")
    counted = counted.groupBy("shard").agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot"))
    texts = shards.select("shard", "docs", "sizes", "body")
    sent = texts.join(counted, "shard", "left").mapInArrow(_send(buckets), SENT)
    told = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sort, "shard bigint, found binary")
    told = told.groupBy("shard").agg(F.collect_list("found").alias("found"))
    return texts.join(told, "shard", "left").mapInArrow(_remove, f"doc_id bigint, n_bytes bigint, removed {SPANS}, kept binary")
