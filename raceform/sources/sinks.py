"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a folder brought together, so that not every task writes every folder.

    The rebalance hint lets AQE split a heavy folder over tasks and join light ones.
    """
    return df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    clustered(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append only rows whose key the table does not hold yet, so a rerun adds nothing; null is a key like others."""
    from raceform.sources.tables import parquet_or_empty

    held = parquet_or_empty(df.sparkSession, path, df.schema).select(*[F.col(k).alias(f"_held_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys])
    append(df.join(held, same, "left_anti").select(*df.columns), path, partition_by)


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite the table, or only the partitions present in ``df`` when partitioned."""
    writer = clustered(df, partition_by).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def upsert(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str]) -> None:
    """Rows of ``df`` take the place of rows with the same keys; all other rows stay. Only folders that ``df`` touches are rewritten.

    Null is a key and a folder like others; ``df`` has each key once. Both sides are stored first, since the table is read and
    overwritten: a plain folder has no older state to go back to, so a job uses ``RunStore.upsert``.
    """
    from raceform.session import materialize
    from raceform.sources.runs import in_folders, same_row
    from raceform.sources.tables import parquet_or_empty

    new = materialize(df, "upsert-new")
    touched = [tuple(r) for r in new.select(*partition_by).distinct().collect()]
    held = parquet_or_empty(df.sparkSession, path, new.schema).where(in_folders(touched, partition_by))
    renewed = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    kept = held.join(renewed, same_row(held, renewed, keys, "_new_"), "left_anti")
    replace(materialize(kept.select(*new.columns).unionByName(new), "upsert"), path, partition_by)


def race_results(df: DataFrame, path: str, race: str = "race_id", partition_by: str = "date", tie: Sequence[str] = ()) -> None:
    """Report rows as Parquet and CSV, one folder per day, rows of a race next to each other.

    A folder per race would mean millions of tiny files; reading one race prunes to its day and,
    by the sort, to a few row groups. The range partitioning splits a heavy day or race over tasks.
    """
    order = [partition_by, race, *tie]
    laid = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy(partition_by).parquet(f"{path}/parquet")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet")
    written.write.mode("overwrite").partitionBy(partition_by).option("header", True).csv(f"{path}/csv")


def records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*")).alias(name))
