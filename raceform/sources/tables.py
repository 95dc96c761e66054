"""Scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def updated_since(df: DataFrame, threshold: str, column: str = "update_at", partition: str | None = None) -> DataFrame:
    """Rows whose text timestamp is at or after ``threshold``.

    ``partition`` names an ingest-date column; the same bound on it prunes folders.
    """
    rows = df.where(F.try_to_timestamp(F.col(column)) >= F.lit(threshold).cast("timestamp"))
    if partition:
        rows = rows.where(F.col(partition) >= F.lit(threshold).cast("timestamp").cast("date"))
    return rows


def years(df: DataFrame, first: int, last: int, column: str = "year") -> DataFrame:
    return df.where(F.col(column).between(first, last))


def surface_history(df: DataFrame, surface: str, column: str = "surface") -> DataFrame:
    return df.where(F.col(column) == surface)


def before_day(df: DataFrame, day: str, column: str = "date") -> DataFrame:
    return df.where(F.col(column) < F.lit(day).cast("date"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds anything, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def folders(spark: SparkSession, path: str, depth: int, hidden: bool = False) -> list[str]:
    """Relative names of the folders ``depth`` levels below ``path``; those that readers skip only if ``hidden``."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    found = [("", top)]
    for _ in range(depth):
        found = [(f"{name}/{s.getPath().getName()}".lstrip("/"), s.getPath()) for name, at in found for s in system.listStatus(at) if s.isDirectory()]
    return sorted(name for name, _ in found if hidden or not any(part[:1] in "_." for part in name.split("/")))


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def csv_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with an explicit schema; an absent path gives an empty table of that schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def export_columns(spark: SparkSession, table: str, columns: Sequence[str], path: str) -> bool:
    """Write the chosen columns of a catalog table as CSV; a missing table is left alone."""
    if not spark.catalog.tableExists(table):
        return False
    spark.table(table).select(*columns).write.mode("overwrite").option("header", True).csv(path)
    return True
