"""Append tables that know their keys: bucketed and sorted, so that a batch is compared with the table without moving the table."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceform.sources import tables

BUCKETS = 64
# Slots even out the buckets that Spark deals them to.
SLOTS_PER_BUCKET = 16
KEY, SLOT = "_key", "_slot"
# A join may use a layout by one of its keys.
BY_ONE_KEY = "spark.sql.requireAllClusterKeysForCoPartition"


def key_text(columns: Sequence[str]) -> Column:
    """One text per key; null is a value of its own, and no two keys have the same text."""
    parts = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(*parts)


@contextmanager
def by_one_key(spark: SparkSession) -> Iterator[None]:
    """Plans made inside join a keyed table without moving it."""
    before = spark.conf.get(BY_ONE_KEY)
    spark.conf.set(BY_ONE_KEY, "false")
    try:
        yield
    finally:
        spark.conf.set(BY_ONE_KEY, before)


class KeyedTable:
    """Rows under ``path``, one per key, in folders by ``partition_by`` and in each folder bucketed by a slot of the key.

    The number of buckets is that of the first write. Plain readers see the rows with two more columns.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], partition_by: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.partition_by = spark, path.rstrip("/"), list(keys), list(partition_by)
        self.columns = schema.fieldNames()
        marks = [re.fullmatch(r"_buckets_(\d+)", name) for name in tables.folders(spark, self.path, 1, hidden=True)]
        held = [int(m[1]) for m in marks if m]
        self.buckets = held[0] if held else buckets
        if not held:
            tables.make_folder(spark, f"{self.path}/_buckets_{buckets}")
        self.name = f"raceform_keyed_{md5(self.path.encode()).hexdigest()[:16]}"
        self._order = [c for c in self.columns if c not in self.partition_by] + [KEY, SLOT] + self.partition_by
        kinds = {f.name: f.dataType.simpleString() for f in schema} | {KEY: "string", SLOT: "int"}
        declared = ", ".join(f"`{c}` {kinds[c]}" for c in self._order)
        folders = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in self.partition_by)})" if self.partition_by else ""
        location = self.path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({declared}) USING parquet {folders} CLUSTERED BY ({SLOT}) SORTED BY ({SLOT}, {KEY}) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{location}'")
        if self.partition_by and spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive":
            spark.catalog.recoverPartitions(self.name)
        spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def keyed(self, df: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64(KEY), F.lit(self.buckets * SLOTS_PER_BUCKET)).cast("int")
        return df.withColumn(KEY, key_text(self.keys)).withColumn(SLOT, slot)

    def _compared(self, df: DataFrame, how: str) -> DataFrame:
        slots = sorted(r[0] for r in df.select(SLOT).distinct().collect())
        held = self.spark.table(self.name).where(F.col(SLOT).isin(slots)).select(SLOT, KEY)
        return df.join(held, [SLOT, KEY], how)

    def missing(self, df: DataFrame) -> DataFrame:
        """Rows of a stored ``df`` (with key and slot) whose key the table has not. Only the buckets of its slots are read, and only their keys."""
        return self._compared(df, "left_anti")

    def known(self, df: DataFrame) -> DataFrame:
        """Rows of a stored ``df`` (with key and slot) whose key the table has, read in the same way."""
        return self._compared(df, "left_semi")

    def new_rows(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose key is not held, one per key: the largest of copies inside ``df``, by its columns in order."""
        from raceform.session import materialize

        values = [c for c in df.columns if c not in self.keys]
        first = self.keyed(df).groupBy(*self.keys, KEY, SLOT).agg(F.max(F.struct(*values)).alias("_v")) if values else self.keyed(df).distinct()
        rows = first.select(*self.keys, *[F.col("_v")[c].alias(c) for c in values], KEY, SLOT)
        return self.missing(materialize(rows, "keyed-batch"))

    def append(self, df: DataFrame) -> None:
        """Add the rows whose key is not held, so that a repeated batch adds nothing."""
        with by_one_key(self.spark):
            self.new_rows(df).select(*self._order).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
