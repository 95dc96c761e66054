"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are cut into segments; for each segment a table lists the codes by its value. A query looks up all values
within a radius of its own segments and grows that radius segment by segment: once segments 0..s have been
searched to radius r and the others to r - 1, every code closer than ``m * r + s + 1`` has been met, since in a code
not met the first s + 1 segments differ in more than r bits and the others in more than r - 1. The search of a query ends when the k-th
verified distance is below that.

Scale: codes are dealt into shards of bounded size and queries into blocks; each pair of a shard and a block is a row
of its own, searched in one task with the shard's tables. A shard returns at most k rows per query, and the best k
over all shards are exact. Vectors are cut to codes before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceform.session import materialize

K = 10
BITS = 64
SEGMENTS = 4
SEGMENT_BITS = BITS // SEGMENTS
SHARD_CODES = 1 << 18
BLOCK_QUERIES = 1 << 13


def flips(radius: int) -> np.ndarray:
    """All changes of a segment in exactly ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)], np.int64)


class MultiIndex:
    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.codes, self.ids, self.tables = codes, ids, []
        for s in range(SEGMENTS):
            values = self.segment(codes, s)
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << SEGMENT_BITS))])))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * SEGMENT_BITS)) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)

    def search(self, code: np.uint64, own: int, k: int, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows but ``own``, by distance, then id; with their distances."""
        met = np.zeros(len(self.codes), bool)
        rows, far = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            if radius == len(masks):
                masks.append(flips(radius))
            for s, (order, begin) in enumerate(self.tables):
                values = int(self.segment(np.array([code]), s)[0]) ^ masks[radius]
                low, n = begin[values], begin[values + 1] - begin[values]
                some = n > 0
                low, n = low[some], n[some]
                new = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
                new = new[~met[new]]
                met[new] = True
                new = new[self.ids[new] != own]
                rows = np.concatenate([rows, new])
                far = np.concatenate([far, np.bitwise_count(self.codes[new] ^ code).astype(np.int64)])
                best = np.lexsort((self.ids[rows], far))[:k]
                rows, far = rows[best], far[best]
                if len(rows) == k and far[-1] < SEGMENTS * radius + s + 1:
                    return rows, far
        return rows, far


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: list[np.ndarray] = []
        held: tuple[int, MultiIndex] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard")[i].as_py()
                if held is None or held[0] != shard:
                    held = shard, MultiIndex(np.array(batch.column("codes")[i].values, np.int64).view(np.uint64), np.array(batch.column("ids")[i].values, np.int64))
                out: list[list[np.ndarray]] = [[], [], []]
                queries = zip(np.array(batch.column("query_ids")[i].values, np.int64), np.array(batch.column("query_codes")[i].values, np.int64).view(np.uint64), strict=True)
                for own, code in queries:
                    rows, far = held[1].search(code, own, k, masks)
                    for column, values in zip(out, (np.full(len(rows), own), held[1].ids[rows], far), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *c])) for c in out], names=["query_id", "neighbour_id", "distance"])

    return run


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(id, code) of vectors (id, vector) with up to 64 dimensions: bit i says that dimension i is positive; null numbers are not. A wider vector is an error."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint"))
    code = F.aggregate(F.transform("vector", bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    wide = F.raise_error(F.concat(F.lit(f"codes have {BITS} bits, a vector has dimensions: "), F.size("vector").cast("string")))
    return vectors.select("id", F.when(F.size("vector") > BITS, wide).otherwise(code).alias("code"))


def nearest(codes: DataFrame, queries: DataFrame, k: int = K, shard_codes: int = SHARD_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, neighbour_id, distance, place): for each query the k rows at the least Hamming distance, of equal ones the least ids.

    Both tables are (id, code); a row is no neighbour of its own id. Rows with a null id or code take no part. A row that
    repeats is one neighbour for each time, its equal ids in no order of their own. With fewer than k others all are
    returned; empty tables give no rows. Extra columns are not looked at.
    """
    codes = materialize(codes.where("id is not null and code is not null").select("id", "code"), "codes")
    queries = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query_code"))
    shards = max(1, -(-codes.count() // shard_codes))
    blocks = max(1, -(-queries.count() // block_queries))
    dealt = lambda df, n, column: df.withColumn("_to", F.pmod(F.xxhash64(column), F.lit(n)))
    packed = dealt(codes, shards, "id").groupBy(F.col("_to").alias("shard")).agg(F.collect_list(F.struct("id", "code")).alias("rows"))
    packed = packed.select("shard", F.col("rows.id").alias("ids"), F.col("rows.code").alias("codes"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = dealt(queries, blocks, "query_id").groupBy(F.col("_to").alias("block")).agg(F.collect_list(F.struct("query_id", "query_code")).alias("rows"))
    asked = asked.select(F.col("block").cast("int"), F.col("rows.query_id").alias("query_ids"), F.col("rows.query_code").alias("query_codes"))
    found = packed.join(asked, "block").mapInArrow(_search(k), "query_id bigint, neighbour_id bigint, distance bigint")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return found.withColumn("place", best.cast("bigint")).where(F.col("place") <= k)
