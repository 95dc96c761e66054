"""Unions, pivots and the pedigree tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A pedigree page lists five generations, 2 + 4 + 8 + 16 + 32 ancestors.
GENERATIONS = 5
ANCESTORS = 62


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; columns missing in one are null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def keyed_union(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One long table out of many keyed ones."""
    return union_tables(*[t.withColumn(key, F.lit(k)) for k, t in tables.items()])


def split_columns(df: DataFrame, column: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """One text column to many; parts past the end are null."""
    parts = F.split(F.col(column), pattern)
    return df.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def unpivot_categories(df: DataFrame, ids: Sequence[str], groups: Mapping[str, Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Wide header groups to long rows: ``groups`` maps a category to its columns, in the order of ``values``."""
    rows = [
        F.struct(F.lit(category).alias("category"), *[F.col(c).alias(v) for c, v in zip(columns, values)])
        for category, columns in groups.items()
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def flatten_pedigree(tree: DataFrame, horse: str, row: str, generations: Sequence[str]) -> DataFrame:
    """Tree page (one row per last-generation ancestor, earlier generations repeated) to ``(horse, pos, ancestor)``.

    A generation lists each distinct path once, in row order; the last one lists every row.
    A page has at most 32 rows, so the per-horse numbering is bounded.
    """
    last = len(generations) - 1
    kind = dict(tree.dtypes)[generations[last]]
    # Moved once, as the narrow rows of the page; what follows needs a horse's rows together and moves none.
    pages = tree.select(horse, F.col(row).cast("bigint").alias("_row"), *generations).repartition(F.col(horse))
    items = F.array(*[
        F.struct(
            F.lit(g).alias("gen"),
            F.array(*[F.col(c).cast("string") for c in generations[: g + 1]]).alias("path"),
            (F.col("_row") if g == last else F.lit(-1).cast("bigint")).alias("leaf"),
        )
        for g in range(len(generations))
    ])
    # The ancestor ends its path: a text is no part of the sums, so groups are hashed and not sorted.
    first = pages.select(horse, "_row", F.inline(items)).groupBy(horse, "gen", "path", "leaf").agg(F.min("_row").alias("_row"))
    w = Window.partitionBy(horse).orderBy("gen", "_row")
    return first.select(horse, (F.row_number().over(w) - 1).alias("pos"), F.get("path", F.col("gen")).cast(kind).alias("ancestor"))


def pivot_pedigree(long: DataFrame, horse: str, size: int = ANCESTORS) -> DataFrame:
    """Long pedigree to columns ``peds_0 .. peds_61``; the fixed list spares the distinct-value job."""
    wide = long.groupBy(horse).pivot("pos", list(range(size))).agg(F.max("ancestor"))
    return wide.select(horse, *[F.col(str(i)).alias(f"peds_{i}") for i in range(size)])


def attach_pedigree(entries: DataFrame, long: DataFrame, horse: str, size: int = ANCESTORS) -> DataFrame:
    return entries.join(pivot_pedigree(long, horse, size), horse, "left")
