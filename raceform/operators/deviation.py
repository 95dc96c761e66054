"""Deviation scores: ((x - mean) / sd) * 10 + offset within a group.

Group statistics are aggregated and joined back; a window over the group would put every row
of one round or class into one task. Sums are kept in whole thousandths, so scores do not
depend on row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.functions.exact import sum_of_squares, units

# Score offsets and the number of decimals of probabilities and scores.
OFFSETS = {"p1": 60.0, "p2": 25.0, "p3": 15.0, "p_other": 0.0, "top3": 60.0, "expected": 50.0}
INVERTED = {"expected"}
DECIMALS = 3
SUMMED = ("p1", "p2", "p3")


def _sums(columns: Sequence[str]) -> list[Column]:
    out = []
    for c in columns:
        u = units(F.col(c), DECIMALS)
        out += [F.count(u).alias(f"_n_{c}"), F.sum(u).alias(f"_s_{c}"), sum_of_squares(u).alias(f"_q_{c}")]
    return out


def _mean(c: str) -> Column:
    return F.try_divide(F.col(f"_s_{c}").cast("double") / F.lit(float(10**DECIMALS)), F.col(f"_n_{c}").cast("double"))


def _sd(c: str, ddof: int) -> Column:
    n, s, q = (F.col(f"_{k}_{c}").cast("double") for k in "nsq")
    spread = F.greatest(q - F.try_divide(s * s, n), F.lit(0.0))
    return F.when(F.col(f"_n_{c}") > ddof, F.sqrt(F.try_divide(spread, n - ddof)) / F.lit(float(10**DECIMALS)))


def _score(c: str, offset: float, inverted: bool) -> Column:
    z = F.try_divide(F.col(c) - _mean(c), F.nullif(_sd(c, 1), F.lit(0.0))) * 10
    return F.bround((-z if inverted else z) + offset, DECIMALS)


def _scores(columns: Sequence[str], prefix: str) -> list[Column]:
    return [_score(c, OFFSETS[c], c in INVERTED).alias(f"{prefix}{c}") for c in columns]


def _with_total(df: DataFrame, prefix: str, round_total: bool) -> DataFrame:
    total = F.col(f"{prefix}{SUMMED[0]}") + F.col(f"{prefix}{SUMMED[1]}") + F.col(f"{prefix}{SUMMED[2]}")
    return df.withColumn(f"{prefix}sum", F.bround(total, 0) if round_total else total)


def race_deviation(df: DataFrame, race: str = "race_id", columns: Sequence[str] = ("p1", "p2", "p3", "top3", "expected")) -> DataFrame:
    """Scores within each race; a single runner, an even field or a row without race scores null."""
    stats = df.groupBy(race).agg(*_sums(columns))
    scored = df.join(stats, race, "left").select(*df.columns, *_scores(columns, "dev_"))
    return _with_total(scored, "dev_", round_total=True)


def history_deviation(
    entries: DataFrame, history: DataFrame, by: str | Sequence[str], race: str = "race_id", date: str = "date",
    columns: Sequence[str] = ("p1", "p2", "p3", "p_other", "expected"), prefix: str | None = None,
) -> DataFrame:
    """Scores of each race against the same group (round, class, perhaps with the surface) in all history before the race's day.

    The group of a race is the history of earlier days plus the race's own rows. History is
    summed per (group, day); a running sum over that calendar-bounded table serves every race. Entries without race, group or day
    score null.
    """
    by = [by] if isinstance(by, str) else list(by)
    prefix = prefix or f"dev_{'_'.join(by)}_"
    sums = _sums(columns)
    names = [f"_{k}_{c}" for c in columns for k in "nsq"]
    daily = history.groupBy(*by, date).agg(*sums)
    own = entries.groupBy(race, *by, date).agg(*sums)
    asked = own.select(*by, date).distinct().withColumn("_asked", F.lit(True))
    merged = daily.unionByName(asked, allowMissingColumns=True).groupBy(*by, date).agg(
        *[F.max(c).alias(c) for c in names], F.max("_asked").alias("_asked")
    )
    before = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    running = merged.select(*by, date, "_asked", *[F.sum(c).over(before).alias(f"h{c}") for c in names]).where("_asked")
    stats = own.join(running, [*by, date]).select(
        race, *by, date, *[(F.col(c) + F.coalesce(F.col(f"h{c}"), F.lit(0))).alias(c) for c in names]
    )
    scored = entries.join(stats, [race, *by, date], "left").select(*entries.columns, *_scores(columns, prefix))
    return _with_total(scored, prefix, round_total=False)


def population_score(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """``int(10 * z + 50)`` with the population standard deviation; null where the group does not vary or is null."""
    stats = df.groupBy(*by).agg(*_sums([column]))
    z = F.try_divide(F.col(column) - _mean(column), F.nullif(_sd(column, 0), F.lit(0.0)))
    return df.join(stats, list(by), "left").select(*df.columns, (z * 10 + 50).cast("bigint").alias(name))


def sample_scale(df: DataFrame, column: str, by: Sequence[str], name: str) -> DataFrame:
    """Sample z-score; 0 where the group does not vary, null for a single row or a null group."""
    stats = df.groupBy(*by).agg(*_sums([column]))
    sd = _sd(column, 1)
    z = F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(column) - _mean(column), sd))
    return df.join(stats, list(by), "left").select(*df.columns, z.alias(name))
