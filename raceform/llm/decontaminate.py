"""Benchmark decontamination with an FM-index per training shard.

Words of a shard that no benchmark item uses become one gap symbol, also between documents, since no phrase
can reach over them; what remains is indexed. All phrases are searched backwards at once through the
ranks of a wavelet tree, their occurrences are located from sampled suffix positions, and spans of words are
merged per document. A document longer than a shard is cut with an overlap of the longest phrase.

Scale: no shuffle of documents. The benchmark is broadcast in blocks of bounded size, and each block is one
more pass in the same stage; a task holds one Arrow batch and the index of one shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceform.llm.fm_index import FmIndex

PHRASE_WORDS = 10
SHARD_WORDS = 400_000
BLOCK_BYTES = 16 << 20
GAP = 1
# Words in texts whose capitals still stand.
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Bytes of words as they are, capitals lower-cased, all others to spaces.
PLAIN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


class Phrases(NamedTuple):
    vocabulary: dict[bytes, int]
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # phrases of one length, and for each the slice of its items
    items: np.ndarray
    longest: int


def compile_phrases(items: list[tuple[str, bytes | None]], length: int) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], list[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + GAP + 1) for w in words(text)]
        for i in range(max(1, len(ids) - length + 1)) if ids else ():
            owned = owners.setdefault(tuple(ids[i : i + length]), [])
            if not owned or owned[-1] != item:
                owned.append(item)
    groups, flat = [], []
    for size in sorted({len(p) for p in owners}):
        phrases = [p for p in owners if len(p) == size]
        counts = [len(owners[p]) for p in phrases]
        begin = len(flat) + np.concatenate([[0], np.cumsum(counts)])
        for p in phrases:
            flat += owners[p]
        groups.append((np.array(phrases, np.int64), begin[:-1], begin[1:]))
    return Phrases(vocabulary, groups, np.array(flat, object), max([1, *(g[0].shape[1] for g in groups)]))


def search_shard(pieces: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Occurrences (document, first word, end word, items) in pieces (document, offset, word ids)."""
    ids = np.concatenate([x for _, _, piece in pieces for x in (piece, [GAP])]).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum([len(p[2]) + 1 for p in pieces])])[:-1]
    keep = np.append(True, (ids[1:] != GAP) | (ids[:-1] != GAP))
    place = np.flatnonzero(keep)
    index = FmIndex(ids[keep])
    for group, first, last in phrases.groups:
        low, high = index.find(group)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        counts = high[found] - low[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        at = place[index.locate(rows)]
        for which, start in zip(np.repeat(found, counts), at, strict=True):
            piece = int(np.searchsorted(begins, start, "right")) - 1
            document, offset, _ = pieces[piece]
            word = offset + int(start - begins[piece])
            yield document, word, word + group.shape[1], phrases.items[first[which] : last[which]]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def scan(texts: list[bytes | None], phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Per text: number of words, merged word spans that phrases cover, items with phrases in it."""
    sizes: list[int] = []
    spans: dict[int, set[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0
    get = phrases.vocabulary.get

    def flush() -> None:
        for document, start, end, owners in search_shard(pieces, phrases) if pieces else ():
            spans.setdefault(document, set()).add((start, end))
            items.setdefault(document, set()).update(owners)
        pieces.clear()

    for number, text in enumerate(texts):
        found = words(text)
        sizes.append(len(found))
        ids = np.fromiter(map(get, found, repeat(GAP)), np.int32, len(found))
        for offset in range(0, len(ids), shard_words):
            piece = ids[offset : offset + shard_words + phrases.longest - 1]
            pieces.append((number, offset, piece))
            held += len(piece)
            if held >= shard_words:
                flush()
                held = 0
    flush()
    return sizes, [merge_spans(list(spans.get(i, ()))) for i in range(len(texts))], [items.get(i, set()) for i in range(len(texts))]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; what stands between the words of a span goes with them."""
    found = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : found[start][0]])
        at = found[end - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = PHRASE_WORDS, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (of words, merged), ``items`` (ids as text, sorted) and, with ``keep_text``, ``cleaned``.

    A phrase is ``length`` consecutive words of an item (item_id, text); a shorter item, but for an empty one, is one
    phrase. Without ``keep_text`` the text column is left out. A null or empty text has no words, an empty list of spans and is its own
    ``cleaned``; null and empty items have no phrases; a null item_id is named null. Repeated rows are
    handled each for itself, empty tables give empty results or no hits. Extra columns pass through; those
    named like a result are replaced.
    """
    spark = docs.sparkSession
    results = ["n_words", "spans", "items", "cleaned"]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    base = docs.drop(*results)
    out = base.withColumns({"n_words": F.lit(None).cast("bigint"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in rows])
        final = block == blocks - 1
        fields = [f for f in out.schema.fields if keep_text or not final or f.name != "text"]
        if final and keep_text:
            fields.append(T.StructField("cleaned", T.StringType()))
        out = out.mapInArrow(_pass(shared, length, [f.name for f in fields]), T.StructType(fields))
    return out


def _pass(shared, length: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = compile_phrases(shared.value, length)
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts = column["text"].cast(pa.binary()).to_pylist()
            sizes, spans, items = scan(texts, phrases)
            earlier_spans, earlier_items = column["spans"].to_pylist(), column["items"].to_pylist()
            spans = [merge_spans(new + [(s["start"], s["end"]) for s in old]) for new, old in zip(spans, earlier_spans, strict=True)]
            column["n_words"] = pa.array(sizes, pa.int64())
            column["spans"] = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPAN_TYPE)
            column["items"] = pa.array([sorted(new | set(old)) for new, old in zip(items, earlier_items, strict=True)], pa.list_(pa.string()))
            if "cleaned" in columns:
                column["cleaned"] = pa.array([t if t is None else cut(t.decode(), s) if s else t.decode() for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([column[c] for c in columns], names=columns)

    return run
