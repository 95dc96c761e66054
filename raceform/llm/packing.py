"""Token sequences packed by best fit, certified by lower bounds.

Method: pieces are dealt into partitions by hash, and each is packed by best-fit decreasing. Of the dual feasible functions, the one that bounds
all pieces best is taken; by it a partition has a lower bound, too, and one that meets it is certified: it uses less than
one sequence beyond its share of the bound of all. Partitions with a gap exchange their pieces, certified
ones only those of their least filled sequence; these are dealt anew into partitions of twice the size and packed again, until
the bound of all pieces is met; a round that saves no sequence changes nothing.

Scale: documents are tokenized where they are read, and only the small columns of their pieces are shuffled. A partition has some
``PARTITION_PIECES`` pieces, ``2 ** (MAX_ROUNDS - 1)`` times as many in the last round, whatever the table's size, as rows are dealt by
a stored row number; repeated rows are spread like any others. A round handles what the last one left open. The driver gets
counts, and the histogram of lengths, which has no more rows than a sequence has tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil
from struct import pack as pack_ids
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from raceform.session import materialize

CAPACITY = 4096
END = 1
PARTITION_PIECES = 1 << 14
MAX_ROUNDS = 6
# Words kept with their ids by each worker, and the longest such word.
KEPT_WORDS, KEPT_CHARS = 1 << 19, 64
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
LETTERS_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)").fullmatch
PIECE_CHARS = 1 << 20
# Functions u(k) of the bound.
STEPS = 60


class WordIds(dict):
    """Little-endian ids of words that stand between spaces. The vocabulary drops white space, so a text's ids are those of its words.

    Most words are Latin letters, perhaps with punctuation behind them: those are one unit each, no rule of the vocabulary joins or
    changes them but lower-casing, and its merges are asked for the unit alone. All others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if parts := LETTERS_AND_MARKS(word):
            found = self[parts[1]] + self[parts[2]]
        elif LETTERS(word):
            units = self.tokenizer.model.tokenize(word.lower().translate(self.spelling))
            found = pack_ids(f"<{len(units)}I", *[u.id for u in units])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = pack_ids(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_CHARS:
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        return b"".join(self._parts(text))

    def _parts(self, text: str) -> Iterator[bytes]:
        start = 0
        text = text.replace("\n", " ")
        while start < len(text):
            end = text.find(" ", start + PIECE_CHARS)
            end = len(text) if end < 0 else end
            yield b"".join(map(self.__getitem__, text[start:end].split(" ")))
            start = end


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), with ``keep_ids`` also the little-endian ids; ``tokenizer``: path of a vocabulary that all machines have."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words.ids(text.as_py()) + tail
                for number, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(columns, (doc_id, number, start, len(own) // 4, crc32(own), own if keep_ids else None), strict=True):
                        column.append(value)
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + keep_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def rounded_up(histogram: np.ndarray, value: np.ndarray, unit: int) -> int:
    return -(-int((histogram * value).sum()) // unit)


def dual_bound(histogram: np.ndarray) -> tuple[int, np.ndarray, int]:
    """Least number of sequences by dual feasible functions, with the function that gives it: its value for each length, and the value of a sequence.

    ``histogram[n]``: pieces of length n, up to the capacity. No set of pieces that fits a sequence has a larger value than the sequence.
    """
    capacity = len(histogram) - 1
    size = np.arange(capacity + 1, dtype=np.int64)
    count = histogram.astype(np.int64)
    # Pieces over capacity - a fill a sequence, those under a are left out, others count by length; a = 0 is the sum of lengths.
    above = np.append(np.cumsum(count[::-1])[::-1], 0)
    words = np.append(np.cumsum((count * size)[::-1])[::-1], 0)
    a = np.arange(capacity // 2 + 1)
    least = above[capacity - a + 1] + -(-(words[a] - words[capacity - a + 1]) // capacity)
    cut = int(least.argmax())
    best = int(least[cut]), np.where(size > capacity - cut, capacity, np.where(size >= cut, size, 0)), capacity
    # Lengths rounded down to parts of k, but for those that k + 1 parts hit.
    for k in range(1, STEPS + 1):
        parts = (k + 1) * size
        value = np.where(parts % capacity == 0, k * size, parts // capacity * capacity)
        if (found := rounded_up(count, value, k * capacity)) > best[0]:
            best = found, value, k * capacity
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: sequence and offset of each piece, and how full each sequence is."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a sequence has room r
    fill: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            held = by_room[room]
            bin_ = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            room, bin_ = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = bin_, capacity - room
        fill[bin_] += n
        if room > n:
            if not by_room[room - n]:
                rooms |= 1 << (room - n)
            by_room[room - n].append(bin_)
    return bins, offsets, np.array(fill, np.int64)


@dataclass
class Packing:
    """``pieces``: those given, with sequence_id and offset; ``sequences`` of them in all, of which at least ``bound`` are needed."""

    pieces: DataFrame
    sequences: int
    bound: int


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, max_rounds: int = MAX_ROUNDS) -> Packing:
    """Sequences of at most ``capacity`` tokens for ``pieces`` (length from 1 to capacity, other columns pass through).

    Full pieces are a sequence each. Sequence ids are any numbers; places in a sequence go without a gap from 0. An
    empty table gives an empty result.
    """
    # Stored, so that row numbers and what they decide are the same in all rounds.
    stored = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    names = pieces.columns
    lengths = stored.groupBy("length").count().collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for row in lengths:
        histogram[row["length"]] = row["count"]
    bound, value, unit = dual_bound(histogram)
    left = int(histogram[:capacity].sum())
    closed = [stored.where(F.col("length") == capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    sequences, free, open_sequences = int(histogram[capacity]), stored.where(F.col("length") < capacity), None

    def packed(table: pa.Table) -> pa.Table:
        bins, offsets, fill = best_fit(table.column("length").to_numpy(), capacity)
        counts = np.bincount(table.column("length").to_numpy(), minlength=capacity + 1)
        certified = len(fill) == rounded_up(counts, value, unit)
        open_ = np.full(len(fill), not certified)
        open_[fill.argmin()] |= fill.min() < capacity
        first = table.column("round")[0].as_py() << 56 | table.column("slot")[0].as_py() << 28
        table = table.select([*names, "row"])
        for name, values in (("sequence_id", first + bins), ("offset", offsets), ("open", open_[bins])):
            table = table.append_column(name, pa.array(values))
        return table

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema) + ", sequence_id long, offset long, open boolean"
    for number in range(max_rounds):
        if not left:
            break
        slots = ceil(left / (partition_pieces << number))
        slot = F.pmod(F.xxhash64("row", F.lit(number)), F.lit(slots))
        rows = free.select(*names, "row", slot.alias("slot"), F.lit(number).cast("long").alias("round"))
        out = materialize(rows.groupBy("slot").applyInArrow(packed, kind), "packed")
        used, still, loose = out.agg(*[F.count_if(F.expr(c)) for c in ("offset = 0", "open", "open and offset = 0")]).first()
        if open_sequences is None or used < open_sequences:
            closed.append(out.where("not open").select(*names, "sequence_id", "offset"))
            sequences += used - loose
            free, left, open_sequences = out.where("open"), still, loose
        if slots == 1 or sequences + open_sequences == bound:
            break
    if open_sequences is not None:
        closed.append(free.select(*names, "sequence_id", "offset"))
        sequences += open_sequences
    result = closed[0]
    for more in closed[1:]:
        result = result.unionByName(more)
    return Packing(result, sequences, bound)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> Packing:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document with sequence_id and offset; ``keep_ids`` adds their ids.

    A document is the ids of its text and the id that ends it; only documents longer than ``capacity`` are cut. A null or empty text is
    its end alone. Strings that look like control tokens are ordinary text. Long texts are tokenized part by part. Rows without or
    with a repeated doc_id, and repeated rows, are documents like others. Other columns are not looked at, whatever their names.
    """
    return pack(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids), capacity)


def filled(packing: Packing) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from pieces that kept their ids."""
    parts = packing.pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids"))
