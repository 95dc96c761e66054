"""Ordered operators that never put all rows of one key into one task.

Two layouts are used. Day layout: rows are grouped by (key, day); a table with one row
per key and day, bounded by the calendar, carries values across days. Range layout:
rows are range-partitioned by their full order, so even one key or one day is spread;
one row per partition carries values across partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.session import materialize


def _desc(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in columns]


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` rows per group. The rank filter lets Spark trim each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*_desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def day_tails(df: DataFrame, key: str, date: str, order: Sequence[str], value: Column, n: int) -> DataFrame:
    """Per key and day the newest ``n`` values as an array, newest first (column ``_tail``)."""
    w = Window.partitionBy(key, date).orderBy(*_desc(order))
    ranked = (
        df.select(key, date, *[c for c in order if c not in (key, date)], value.alias("_value"))
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
    )
    packed = F.sort_array(F.collect_list(F.struct("_rn", "_value")))
    return ranked.groupBy(key, date).agg(F.transform(packed, lambda x: x["_value"]).alias("_tail"))


def lag_features(
    df: DataFrame,
    key: str,
    date: str,
    order: Sequence[str],
    features: Sequence[str],
    n: int = 5,
    one_per_day: bool = False,
) -> DataFrame:
    """Add ``<feature>1..n`` and ``<date>1..n``: values of the n previous rows of the same key.

    ``one_per_day`` states that (key, date) is unique; a key's rows are then bounded by the
    calendar and one window does it. Otherwise rows stay in (key, date) groups and the tails
    of earlier days are joined in.
    """
    columns = [date, *[f for f in features if f != date]]
    names = [(f"{c}{i}", c, i) for i in range(1, n + 1) for c in columns]
    if one_per_day:
        w = Window.partitionBy(key).orderBy(*_desc([date, *order]))
        packed = df.withColumn("_now", F.struct(*columns))
        lagged = packed.select("*", *[F.lead("_now", i).over(w).alias(f"_lag{i}") for i in range(1, n + 1)])
        picked = [F.col(f"_lag{i}")[c].alias(name) for name, c, i in names]
        return lagged.select(*df.columns, *picked)

    value = F.struct(*columns)
    # Moved before the structs are made, so that no value is sent twice.
    df = df.repartition(key, date)
    w_day = Window.partitionBy(key, date).orderBy(*_desc(order))
    same_day = F.array_compact(F.array(*[F.lead("_now", i).over(w_day) for i in range(1, n + 1)]))
    rows = df.withColumn("_now", value).withColumn("_same_day", same_day)

    w_key = Window.partitionBy(key).orderBy(date)
    earlier = F.flatten(F.array_compact(F.array(*[F.lag("_tail", i).over(w_key) for i in range(1, n + 1)])))
    carried = day_tails(df, key, date, order, value, n).select(key, date, F.slice(earlier, 1, n).alias("_earlier"))

    joined = rows.join(carried, [key, date], "left")
    lags = F.when(F.col("_earlier").isNull(), F.col("_same_day")).otherwise(F.concat("_same_day", "_earlier"))
    picked = [F.get("_lags", F.lit(i - 1))[c].alias(name) for name, c, i in names]
    return joined.withColumn("_lags", lags).select(*df.columns, *picked)


def forward_fill(
    df: DataFrame, key: str, date: str, order: Sequence[str], columns: Sequence[str], newest_first: bool = False
) -> DataFrame:
    """Replace nulls by the last non-null value of the same key in (date, order) order.

    ``newest_first`` runs from the newest row back, so later values fill earlier rows.
    """
    way = (lambda c: F.col(c).desc()) if newest_first else (lambda c: F.col(c).asc())
    w_day = Window.partitionBy(key, date).orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    w_key = Window.partitionBy(key).orderBy(way(date)).rowsBetween(Window.unboundedPreceding, -1)

    place = F.struct(*order)
    pick = F.min_by if newest_first else F.max_by
    day_last = df.groupBy(key, date).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_day_{c}") for c in columns]
    )
    carried = day_last.select(key, date, *[F.last(f"_day_{c}", True).over(w_key).alias(f"_carry_{c}") for c in columns])
    filled = df.select("*", *[F.last(c, True).over(w_day).alias(f"_in_{c}") for c in columns])
    # Rows without a date stand at one end of their key and are filled like others.
    same_day = (filled[key] == carried[key]) & filled[date].eqNullSafe(carried[date])
    out = filled.join(carried, same_day, "left")
    return out.select(
        *[F.coalesce(f"_in_{c}", f"_carry_{c}").alias(c) if c in columns else filled[c] for c in df.columns]
    )


def range_chunks(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned by ``order`` with their partition number in ``_chunk``, written once.

    Equal order tuples share a chunk; a full tie-break in ``order`` keeps chunks even.
    The write pins the numbers, so a lost executor cannot change them.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in order])
    return materialize(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")


def forward_fill_all(df: DataFrame, order: Sequence[str], columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Forward fill over the whole table in ``order``, without a one-task window over rows."""
    chunks = range_chunks(df, order, partitions)
    w_in = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range partition: this window's input is bounded by the partition count.
    w_over = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = chunks.groupBy("_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_end_{c}") for c in columns]
    )
    carried = ends.select("_chunk", *[F.last(f"_end_{c}", True).over(w_over).alias(f"_carry_{c}") for c in columns])
    filled = chunks.select("*", *[F.last(c, True).over(w_in).alias(f"_in_{c}") for c in columns])
    out = filled.join(F.broadcast(carried), "_chunk")
    return out.select(
        *[F.coalesce(f"_in_{c}", f"_carry_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n", partitions: int | None = None
) -> DataFrame:
    """``row_number`` per group in ``order``, exact even if one group is most of the table.

    Rows are numbered inside range partitions. Only a group that began in an earlier
    partition needs an offset, at most one per partition, so the offsets are broadcast.
    """
    chunks = range_chunks(df, [*by, *order], partitions)
    sizes = chunks.groupBy("_chunk", *by).agg(F.count(F.lit(1)).alias("_size"))
    w_over = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("_before", F.sum("_size").over(w_over))
        .where(F.col("_before") > 0)
        .select("_chunk", *[F.col(c).alias(f"_by_{c}") for c in by], "_before")
    )
    w_in = Window.partitionBy("_chunk", *by).orderBy(*order)
    numbered = chunks.withColumn("_in", F.row_number().over(w_in))
    same = numbered["_chunk"] == offsets["_chunk"]
    for c in by:
        same = same & numbered[c].eqNullSafe(offsets[f"_by_{c}"])
    joined = numbered.join(F.broadcast(offsets), same, "left")
    return joined.select(
        *[numbered[c] for c in df.columns],
        (F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint").alias(name),
    )


def latest_values(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Last non-null value of every column per group; rows with a null group key are dropped."""
    columns = [c for c in (columns or df.columns) if c not in by]
    place = F.struct(*order)
    return (
        df.na.drop(subset=list(by))
        .groupBy(*by)
        .agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
    )


def merge_copies(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``latest_values`` for wide rows that mostly have no copies: one row per group, last non-null per column.

    Groups with copies are found from the keys alone and written, so that Spark knows how few they are. Rows of other
    groups pass as they are, without a shuffle; only the rest is merged column by column.
    """
    keyed = df.na.drop(subset=list(by))
    copied = materialize(keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*by), "copied")
    merged = latest_values(keyed.join(copied, list(by), "left_semi").select(*df.columns), by, order)
    return keyed.join(copied, list(by), "left_anti").select(*df.columns).unionByName(merged)


def split_by_date(df: DataFrame, id_col: str, date: str, test_size: float = 0.3) -> DataFrame:
    """Add ``is_train``: the first ``round(n * (1 - test_size))`` distinct ids in date order, those without a date last.

    Ids are counted per day (a table bounded by the calendar); only ids of the day the cut
    falls on are ranked, by hash, in hash buckets.
    """
    ids = df.groupBy(id_col).agg(F.min(date).alias("_day"))
    # Unpartitioned windows below run over one row per day and over 65,536 buckets at most.
    in_order = F.col("_day").asc_nulls_last()
    w_days = Window.orderBy(in_order).rowsBetween(Window.unboundedPreceding, 0)
    w_total = Window.orderBy(in_order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = (
        ids.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col("_day").alias("_of_day"),
            (F.sum("_n").over(w_days) - F.col("_n")).alias("_before"),
            F.sum("_n").over(w_days).alias("_through"),
            F.bround(F.sum("_n").over(w_total) * F.lit(1 - test_size)).cast("bigint").alias("_cut"),
        )
    )
    dated = ids.join(F.broadcast(days), F.col("_day").eqNullSafe(F.col("_of_day")))
    whole = dated.where((F.col("_through") <= F.col("_cut")) | (F.col("_before") >= F.col("_cut"))).select(
        id_col, (F.col("_through") <= F.col("_cut")).alias("is_train")
    )
    cut_day = dated.where((F.col("_before") < F.col("_cut")) & (F.col("_through") > F.col("_cut"))).select(
        id_col, (F.col("_cut") - F.col("_before")).alias("_take"), F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("_hash")
    ).withColumn("_bucket", F.substring("_hash", 1, 4))
    w_buckets = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut_day.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(w_buckets), F.lit(0)).alias("_start"))
    )
    w_in = Window.partitionBy("_bucket").orderBy("_hash", id_col)
    ranked = cut_day.withColumn("_in", F.row_number().over(w_in)).join(F.broadcast(starts), "_bucket").select(
        id_col, (F.col("_start") + F.col("_in") <= F.col("_take")).alias("is_train")
    )
    parts = whole.unionByName(ranked).withColumnRenamed(id_col, "_id")
    return df.join(parts, F.col(id_col).eqNullSafe(F.col("_id"))).select(*df.columns, "is_train")
