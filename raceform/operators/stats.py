"""Aggregates of the modelling and evaluation steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.functions.exact import sum_of_squares, units
from raceform.functions.numeric import clamp_z
from raceform.operators.ordered import split_by_date  # noqa: F401  (date-ordered split is part of this group)
from raceform.session import materialize


def win_rate(rank: Column) -> Column:
    return F.try_divide(F.count_if(rank == 1).cast("double"), F.count(rank).cast("double"))


def with_win_rate(df: DataFrame, jockey: str, rank: str, name: str = "jockey_win_rate") -> DataFrame:
    """Jockey's overall win rate on every row: aggregate first, then join the small result back, stored so that its size is known."""
    rates = df.where(F.col(jockey).isNotNull()).groupBy(jockey).agg(win_rate(F.col(rank)).alias(name))
    return df.join(materialize(rates, "rates"), jockey, "left")


def with_win_rate_before(df: DataFrame, jockey: str, date: str, rank: str, name: str = "jockey_win_rate") -> DataFrame:
    """Win rate over earlier days only, so a row never sees its own result."""
    daily = df.where(F.col(jockey).isNotNull()).groupBy(jockey, date).agg(
        F.count_if(F.col(rank) == 1).alias("_w"), F.count(rank).alias("_n")
    )
    before = Window.partitionBy(jockey).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    rates = daily.select(
        jockey, date,
        F.try_divide(F.sum("_w").over(before).cast("double"), F.sum("_n").over(before).cast("double")).alias(name),
    )
    return df.join(rates, [jockey, date], "left")


def exact_moments(column: str, decimals: int) -> list[Column]:
    """Count, sum and sum of squares over whole units of ``10**-decimals``."""
    u = units(F.col(column), decimals)
    return [F.count(u).alias("n"), F.sum(u).alias("s"), sum_of_squares(u).alias("q")]


def mean_and_std(df: DataFrame, column: str, decimals: int) -> DataFrame:
    """One row ``(mean, sd)``: sample standard deviation from exact sums."""
    n, s, q = F.col("n").cast("double"), F.col("s").cast("double"), F.col("q").cast("double")
    unit = F.lit(float(10**decimals))
    return df.agg(*exact_moments(column, decimals)).select(
        F.try_divide(s / unit, n).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))) / unit).alias("sd"),
    )


SCORE_DECIMALS = 9


def time_scores(df: DataFrame, seconds: str, name: str = "run_time") -> tuple[DataFrame, DataFrame]:
    """Negated, clamped and twice standardised time, plus the two-row statistics table.

    The statistics are single-row subqueries, so rows are never moved to one task. Scores are
    kept to nine decimals between the two passes, which makes the second statistics exact sums.
    """
    first = mean_and_std(df, seconds, 1)
    z = -F.try_divide(F.col(seconds) - first.select("mean").scalar(), first.select("sd").scalar())
    once = df.withColumn(name, F.round(clamp_z(z), SCORE_DECIMALS))
    second = mean_and_std(once, name, SCORE_DECIMALS)
    score = F.try_divide(F.col(name) - second.select("mean").scalar(), second.select("sd").scalar())
    table = first.select(F.lit("First Time").alias("step"), "mean", "sd").unionByName(
        second.select(F.lit("Second Time").alias("step"), "mean", "sd")
    )
    return once.withColumn(name, score), table


def apply_time_scores(df: DataFrame, seconds: str, table: DataFrame, name: str = "run_time") -> DataFrame:
    """Score new rows with statistics fitted earlier."""
    def value(step: str, column: str) -> Column:
        return table.where(F.col("step") == step).select(column).scalar()

    z = -F.try_divide(F.col(seconds) - value("First Time", "mean"), value("First Time", "sd"))
    clamped = F.round(clamp_z(z), SCORE_DECIMALS)
    return df.withColumn(name, F.try_divide(clamped - value("Second Time", "mean"), value("Second Time", "sd")))


def tier_statistics(history: DataFrame, jockey: str, rank: str, tiers: Sequence[str]) -> DataFrame:
    """Mean (3 places), max and min of the tier scores over each jockey's top-3 finishes."""
    placed = history.where(F.col(rank) < 4)
    aggs = []
    for t in tiers:
        cents = F.round(F.col(t) * 100).cast("bigint")
        mean = F.try_divide(F.sum(cents).cast("double") / F.lit(100.0), F.count(cents).cast("double"))
        aggs += [F.round(mean, 3).alias(f"mean_{t}"), F.max(t).alias(f"max_{t}"), F.min(t).alias(f"min_{t}")]
    return placed.groupBy(jockey).agg(*aggs)


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights ``n / (k * n_c)``: one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    totals = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    n, k = totals.select("n").scalar(), totals.select("k").scalar()
    return counts.select(label, (n.cast("double") / (k * F.col("n_c"))).alias(name))


def confusion(df: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """Cells and their shares of the rows that have a label and a score; other rows are in no cell and not in ``total``."""
    hit, positive = F.col(probability) >= threshold, F.col(label) == 1
    cells = {"tp": positive & hit, "fp": ~positive & hit, "tn": ~positive & ~hit, "fn": positive & ~hit}
    scored = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull())
    counts = scored.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in cells.items()])
    shares = [(F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")) * 100).alias(f"{c}_pct") for c in cells]
    return counts.select("*", *shares)


AUC_BUCKETS = 2**20


def roc_auc(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; rows without label or score are left out.

    Rows collapse to one per distinct score; scores are ranked inside probability buckets, and
    only the bucket totals (2**20 at most) pass through one ordered window.
    """
    p = F.col(probability)
    scores = (
        df.where(p.isNotNull() & F.col(label).isNotNull()).groupBy(p.alias("_p"))
        .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
        .withColumn("_bucket", F.floor(F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(1.0)) * AUC_BUCKETS))
    )
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = scores.groupBy("_bucket").agg(F.sum("_neg").alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_neg_before")
    )
    inside = Window.partitionBy("_bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = scores.withColumn("_neg_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(buckets, "_bucket")
    wins = F.sum((F.col("_pos") * (2 * (F.col("_neg_before") + F.col("_neg_in")) + F.col("_neg"))).cast("decimal(38,0)"))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double") * 2
    return ranked.agg(F.try_divide(wins.cast("double"), pairs).alias("auc"))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def standardise(df: DataFrame, columns: Mapping[str, int], by: Sequence[str], drop: bool = True, prefix: str = "std_") -> DataFrame:
    """Population z-score per group for a list of columns; null where the group does not vary or is null."""
    aggs, out = [], []
    for c, decimals in columns.items():
        u = units(F.col(c), decimals)
        aggs += [F.count(u).alias(f"_n_{c}"), F.sum(u).alias(f"_s_{c}"), sum_of_squares(u).alias(f"_q_{c}")]
        n, s, q = (F.col(f"_{k}_{c}").cast("double") for k in "nsq")
        unit = F.lit(float(10**decimals))
        sd = F.sqrt(F.greatest(F.try_divide(q - F.try_divide(s * s, n), n), F.lit(0.0))) / unit
        out.append(F.try_divide(F.col(c) - F.try_divide(s / unit, n), F.nullif(sd, F.lit(0.0))).alias(prefix + c))
    stats = df.groupBy(*by).agg(*aggs)
    kept = [c for c in df.columns if not (drop and c in columns)]
    return df.join(stats, list(by), "left").select(*kept, *out)
