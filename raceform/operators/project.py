"""Whole-row projections and filters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceform.functions.text import null_if_text

SENTINELS = ("", "---")


def sentinels_to_null(df: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Missing-value texts become null in every string column."""
    return df.select(*[
        null_if_text(F.col(f.name), *sentinels).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "") for c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def reconcile(df: DataFrame, contract: Sequence[str] | Mapping[str, object]) -> DataFrame:
    """Exactly the contract's columns in its order; missing ones are filled with their default (0)."""
    defaults = contract if isinstance(contract, Mapping) else dict.fromkeys(contract, 0)
    return df.select(*[F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in defaults.items()])


def stored_columns(df: DataFrame, features: DataFrame, feature_set: str) -> DataFrame:
    """Projection by a stored column list ``(feature_set, position, name)``: a few hundred names at most."""
    rows = features.where(F.col("feature_set") == feature_set).orderBy("position").select("name").collect()
    return df.select(*[r["name"] for r in rows])


def in_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def complete_races(entries: DataFrame, race: str, ids: Sequence[str]) -> DataFrame:
    """Keep races in which every row has all ids."""
    full = F.lit(True)
    for c in ids:
        full = full & F.col(c).isNotNull()
    good = entries.groupBy(race).agg(F.min(full).alias("_full")).where("_full").select(race)
    return entries.join(good, race, "left_semi")


# With these bases the test below is exact for all 64-bit numbers.
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def prime_number(n: int) -> bool:
    """Exact for 64-bit numbers, by strong probable-prime tests. Below 2 only 1 is not called prime."""
    if n < 2:
        return n != 1
    for p in WITNESSES:
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in WITNESSES:
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def with_primality(df: DataFrame, column: str, name: str = "is_prime") -> DataFrame:
    """Primality of an integer column, tested once per distinct value. The cost of a value grows with its digits, not with its size; null gives null."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            yield pa.RecordBatch.from_arrays([values, pa.array([prime_number(n) for n in values.to_pylist()], pa.bool_())], names=[column, name])

    keys = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(keys.mapInArrow(tested, f"`{column}` {dict(df.dtypes)[column]}, `{name}` boolean"), column, "left")
