"""Incremental twins of the batch jobs. Each run drains what has arrived and stops."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from raceform.plans import scoring
from raceform.sources import sinks, tables

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark: SparkSession, folder: str, name_pattern: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name_pattern).parquet(folder)


def clean_since(stream: DataFrame, time_column: str, threshold: str, out: str, checkpoint: str) -> None:
    """Append rows at or past ``threshold`` to ``out``; a rerun continues from the checkpoint."""
    rows = stream.where(F.col(time_column).cast("timestamp") >= F.lit(threshold).cast("timestamp"))
    (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def collect_new(stream: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, checkpoint: str, seed: DataFrame | None = None) -> None:
    """Append the first row of every key not held yet.

    What was seen lives in the table, not in operator state, so it may grow without bound. A
    replayed batch rewrites its own folder and is compared with the other folders only.
    """
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = tables.parquet_or_empty(spark, out, schema).where(F.col("batch") != batch_id).select(*keys)
        fresh = batch.join(held, list(keys), "left_anti")
        if seed is not None:
            fresh = fresh.join(seed.select(*keys), list(keys), "left_anti")
        values = [c for c in columns if c not in keys]
        first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
        rows = first.select(*keys, *[F.col("_v")[c].alias(c) for c in values]).select(*columns)
        sinks.replace(rows.withColumn("batch", F.lit(batch_id).cast("bigint")), out, ["batch"])

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def score_requests(
    requests: DataFrame, key: str, features: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Score the entries of requested races as requests arrive.

    A race asked for several times in one batch is scored once per batch; each batch owns a
    folder, so a replay overwrites its own results.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select(key).distinct()
        rows = scorer(features.join(asked, key, "left_semi"))
        sinks.replace(rows.withColumn("batch", F.lit(batch_id).cast("bigint")), out, ["batch"])

    (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


class FirstSeen(StatefulProcessor):
    """Passes the first row of a key, by ``order`` within a batch, and remembers the key."""

    def __init__(self, order: Sequence[str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def _place(self, row: Row) -> list[tuple]:
        """What rows are compared by; null comes last."""
        return [(row[c] is None, row[c]) for c in self.order]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.seen.exists():
            return
        first = min(rows, key=self._place)
        self.seen.update((True,))
        yield first

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803
        self.seen.update((True,))

    def close(self) -> None:
        pass


def collect_unseen(stream: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, checkpoint: str, seed: DataFrame | None = None) -> None:
    """Append the first row of every key that neither came before nor is in ``seed``.

    What was seen lives in operator state, on disk and in the checkpoint; ``seed`` is read once, when the stream starts for the first time. No
    batch reads a table, and the file sink takes each row exactly once, so a restart goes on where the stream stopped. Null keys
    are keys like others. Each key's rows of a batch pass one at a time, so a hot key holds no more than the first row so far.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        known = None if seed is None else seed.select(*keys).distinct().groupBy(*keys)
        fresh = stream.groupBy(*keys).transformWithState(
            statefulProcessor=FirstSeen(order), outputStructType=stream.schema, outputMode="Append", timeMode="None", initialState=known)
        (fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(STATE_STORE, before)


def report_requests(
    requests: DataFrame, key: str, entries: DataFrame, registry: DataFrame, models: DataFrame, contract: Mapping[str, Sequence[str]],
    number: str, out: str, checkpoint: str, arrived: str | None = None, again_after: str = "1 day",
) -> None:
    """Report rows of the races asked for, as requests arrive: a stream joined with stored entries, scored by the models inside the streaming plan.

    ``entries`` carry their features, segments and ``number`` within the race. A race is reported once; with ``arrived``, the time column of the requests, it is reported again when
    asked for later than ``again_after``, and the state forgets it after that time. The file sink takes each row exactly once.
    """
    if arrived:
        asked = requests.select(key, F.col(arrived).cast("timestamp").alias("_at")).withWatermark("_at", again_after).dropDuplicatesWithinWatermark([key])
    else:
        asked = requests.select(key).dropDuplicates([key])
    rows = scoring.report_rows(asked.select(key).join(entries, key), registry, models, contract, key, number)
    (rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
