"""Merkle manifest of a table: one tree per group, one over the groups, with a proof for every row.

A leaf is the digest of a row's fields. The leaves of a group, in the order of the key, are paired level by level (a last
single node alone) until one node is left, the group's subroot; subroots in the order of the groups give the root.

Method: a superblock is ``2 ** levels`` consecutive leaves of a group. Positions come from one range shuffle: rows are
sorted inside range partitions, and the counts per partition and group, a table of a row each, carry the rest. Every
superblock is reduced to its top node; those nodes are the leaves of the next, far smaller tree, until one node
per group is left. On the way back, the nodes of a superblock and the outer nodes on its way to the root are cogrouped, and
one call finishes the local levels, joins the proofs and folds the presented leaves.

Scale: texts are hashed where they are read and never shuffled, only digests are. No task holds more than the leaves
of a superblock, however large a group is; the tree has ``log(n) / levels`` rounds. Equal rows differ by their row
number in the sort, so that copies of one row are spread, too. The driver gets counts only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
ROWS_PER_RANGE = 1 << 20
# How monotonically_increasing_id splits into partition and row.
ROW_BITS = 33


def field(value: Column) -> Column:
    """One field as it enters a leaf: its length in bytes and its text, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def digest(*parts: bytes) -> bytes:
    """Digest of the hex texts of digests."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


def grow(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and the levels above them."""
    tree = [nodes]
    for _ in range(levels):
        below = tree[-1]
        tree.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return tree


def siblings(tree: list[list[bytes]], at: int) -> list[str]:
    """What stands beside the way up from node ``at``: side and digest, empty where a node is alone."""
    found = []
    for level in tree[:-1]:
        beside = at ^ 1
        found.append(("l" if beside < at else "r") + level[beside].hex() if beside < len(level) else "")
        at >>= 1
    return found


def fold(start: bytes, proof: list[str]) -> bytes:
    for step in proof:
        beside = bytes.fromhex(step[1:])
        start = digest(beside, start) if step[:1] == "l" else digest(start, beside) if step else digest(start)
    return start


def _numbered(rows: DataFrame, order: list[str], ranges: int, label: str) -> DataFrame:
    """``rows`` with ``position`` in its ``branch`` and the branch's ``total``, stored."""
    salt = F.xxhash64(F.monotonically_increasing_id())
    placed = rows.withColumn("salt", salt).repartitionByRange(ranges, "branch", *order, "salt").sortWithinPartitions("branch", *order, "salt")
    placed = materialize(placed.drop("salt").withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", ROW_BITS)
    runs = placed.groupBy("branch", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    branch = Window.partitionBy("branch")
    before = F.sum("n").over(branch.orderBy("part")) - F.col("n")
    runs = runs.select("branch", "part", (F.col("first") - before).alias("shift"), F.sum("n").over(branch).alias("total"))
    return placed.withColumn("part", part).join(runs, ["branch", "part"]).withColumn("position", F.col("at") - F.col("shift")).drop("at", "part", "shift")


NODE = "branch string, position long, total long, node binary"


def _climb(nodes: DataFrame, levels: int, label: str) -> list[DataFrame]:
    """Tables of nodes from the leaves up to one node per branch."""

    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        branch, total = block["branch"].iloc[0], int(block["total"].iloc[0])
        tree = grow(list(block["node"]), min(levels, depth(total)))
        return pd.DataFrame({"branch": [branch], "position": [int(block["position"].iloc[0]) >> levels], "total": [(total - 1 >> levels) + 1], "node": [tree[-1][0]]})

    tables = [nodes]
    while len(tables) == 1 or (tables[-1].agg(F.max("total")).first()[0] or 1) > 1:
        blocks = tables[-1].select("branch", "position", "total", "node", F.shiftright("position", levels).alias("block"))
        tables.append(materialize(blocks.groupBy("branch", "block").applyInPandas(top, NODE), f"{label}-nodes"))
    return tables


def _descend(tables: list[DataFrame], tops: DataFrame, levels: int, keep_proof: bool, keys: str) -> DataFrame:
    """Rows of the first of ``tables`` with what its way up to the root gives; ``tops``: (branch, position, outer, subroot, root)."""

    def blocks(rows: DataFrame, position: Column) -> DataFrame:
        return rows.withColumn("block", position)

    def down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("position").reset_index(drop=True)
        tree = grow(list(nodes["node"]), min(levels, depth(int(nodes["total"].iloc[0]))))
        way = list(outer["outer"].iloc[0])
        return pd.DataFrame({
            "branch": nodes["branch"], "position": nodes["position"], "outer": [siblings(tree, i) + way for i in range(len(nodes))],
            "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0]})

    def last(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("position").reset_index(drop=True)
        tree = grow(list(nodes["node"]), min(levels, depth(int(nodes["total"].iloc[0]))))
        way, root = list(outer["outer"].iloc[0]), outer["root"].iloc[0]
        proofs = [siblings(tree, i) + way for i in range(len(nodes))]
        folded = [fold(own if claim is None else claim, proof) for own, claim, proof in zip(nodes["node"], nodes["claim"], proofs, strict=True)]
        out = nodes[[c for c in nodes.columns if c not in ("branch", "block", "claim", "total")]].rename(columns={"node": "leaf"})
        out["subroot"], out["root"] = outer["subroot"].iloc[0], root
        out["proof_sha256"] = [hashlib.sha256("".join(s[1:] for s in p).encode()).digest() for p in proofs]
        out["folded_root"], out["verified"] = folded, [f == root for f in folded]
        if keep_proof:
            out["proof"] = proofs
        return out

    outer_type = "branch string, position long, outer array<string>, subroot binary, root binary"
    for nodes in tables[-2:0:-1]:
        left = blocks(nodes, F.shiftright("position", levels)).groupBy("branch", "block")
        tops = materialize(left.cogroup(blocks(tops, F.col("position")).groupBy("branch", "block")).applyInPandas(down, outer_type), "outer-nodes")
    left = blocks(tables[0], F.shiftright("position", levels)).groupBy("branch", "block")
    out_type = f"{keys}, leaf binary, position long, subroot binary, root binary, proof_sha256 binary, folded_root binary, verified boolean" + ", proof array<string>" * keep_proof
    return left.cogroup(blocks(tops, F.col("position")).groupBy("branch", "block")).applyInPandas(last, out_type)


@dataclass
class Manifest:
    """``rows``: one per row of the table; ``subroots``: (branch, total, subroot), ``branch`` being ``-`` for null, else ``=`` and the group."""

    rows: DataFrame
    subroots: DataFrame


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", claim: Column | None = None, levels: int = LEVELS,
             keep_proof: bool = False, rows_per_range: int = ROWS_PER_RANGE) -> Manifest:
    """Rows (key, group, leaf, position, subroot, root, proof_sha256, folded_root, verified), digests as binary.

    ``claim`` is the leaf presented for a row where it isn't the row's own (null: the own one); folded_root is what it and the
    proof give, verified says that this is the root. ``keep_proof`` adds the proof: from the leaf up, ``l`` or ``r`` for the
    sibling's side and its digest, empty where there is none.

    A null group is the first branch, a null key comes first in its branch, a null field enters the leaf as a
    dash, which no text can. Rows with equal keys are ordered by leaf; equal rows have equal leaves and a place each.
    Long texts are hashed in place. An empty table gives no rows. Columns other than ``fields``, group and key are not looked at,
    whatever their names.
    """
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("branch"), F.col(key).alias("key"), F.col(group).alias("group"),
        leaf(*[F.col(f) for f in fields]).alias("node"), (F.lit(None).cast("binary") if claim is None else claim).alias("claim"))
    # As text in Python, where whole numbers beside nulls would turn into floats.
    kind = {name: of for name, of in leaves.dtypes if name in ("key", "group")}
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, ceil(docs.count() / rows_per_range))
    leaves = _numbered(leaves, ["key", "node"], ranges, "leaves").withColumns({c: F.col(c).cast("string") for c in kind})
    tables = _climb(leaves, levels, "group")
    subroots = tables[-1].select(F.lit("").alias("branch"), F.col("branch").alias("of"), "node", F.col("node").alias("subroot"))
    over = _numbered(subroots, ["of"], 1, "subroots")
    roots = _climb(over, levels, "root")
    start = roots[-1].select("branch", "position", F.array().cast("array<string>").alias("outer"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    ways = _descend([over.withColumn("claim", F.lit(None).cast("binary")), *roots[1:]], start, levels, True, "of string")
    tops = ways.select(F.col("of").alias("branch"), F.lit(0).cast("long").alias("position"), F.col("proof").alias("outer"), F.col("leaf").alias("subroot"), "root")
    rows = _descend(tables, materialize(tops, "branches"), levels, keep_proof, "key string, group string").withColumns({c: F.col(c).cast(of) for c, of in kind.items()})
    totals = tables[0].groupBy("branch").agg(F.max("total").alias("total"))
    return Manifest(rows.withColumnsRenamed({"key": key, "group": group}), totals.join(over.select(F.col("of").alias("branch"), "subroot"), "branch"))
