"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from raceform.session import materialize

MAX_ROUNDS = 100


def _stored(edges: DataFrame, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """``edges`` written, and a mark of them that is taken on the way."""
    seen = Observation()
    mark = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("hashes")
    stored = materialize(edges.observe(seen, *mark), label)
    return stored, (int(seen.get["n"]), int(seen.get["hashes"]))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step; ``edges`` have u > v. A large star hangs the larger neighbours of u on u's smallest, a small star the others."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        new = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        new = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    # A large star has a row for each edge at most, copies in it go in the small star that follows.
    return new.where("u > v") if large else new.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node with an edge and not the smallest of its component, with that smallest node.

    ``edges`` are pairs (u, v) of whole numbers in any order; loops, nulls and repeats are harmless. Every step is a
    grouped minimum and a join, both safe for a node with very many edges, and is stored in the shared folder.
    """
    edges, mark = _stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if mark[0] == 0:
        return edges
    for _ in range(MAX_ROUNDS):
        edges, new = _stored(_stars(_stars(edges, True), False), "stars")
        if new == mark:
            return edges
        mark = new
    raise RuntimeError("components did not settle")
