"""Numeric column expressions: differences, ordinals, chained probabilities, odds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ORDINAL_BASE_YEAR = 2010
PAYOUT_RATE = 0.8
CLAMP_LOW, CLAMP_LOW_TO = -3.0, -3.0
CLAMP_HIGH, CLAMP_HIGH_TO = 2.5, 2.0


def corner_differences(first: Column, final: Column, rank: Column) -> dict[str, Column]:
    return {"final_to_rank": final - rank, "first_to_rank": first - rank, "first_to_final": final - first}


def clamp_z(z: Column) -> Column:
    """Outlier rule of the time score: below -3 gives -3, above 2.5 gives 2."""
    return F.when(z < CLAMP_LOW, F.lit(CLAMP_LOW_TO)).when(z > CLAMP_HIGH, F.lit(CLAMP_HIGH_TO)).otherwise(z)


def day_ordinal(date: Column) -> Column:
    return (F.year(date) - ORDINAL_BASE_YEAR) * 365 + F.month(date) * 30 + F.dayofmonth(date)


def date_parts(date: Column) -> dict[str, Column]:
    return {"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)}


def step_differences(columns: list[str], prefix: str) -> dict[str, Column]:
    """``c0-c1, c1-c2, ...`` named prefix, prefix1, ... for columns given newest first."""
    pairs = zip(columns, columns[1:])
    return {f"{prefix}{i or ''}": F.col(a) - F.col(b) for i, (a, b) in enumerate(pairs)}


def step_days(columns: list[str], prefix: str) -> dict[str, Column]:
    pairs = zip(columns, columns[1:])
    return {f"{prefix}{i or ''}": F.datediff(F.col(a), F.col(b)).cast("double") for i, (a, b) in enumerate(pairs)}


def row_sum(*values: Column) -> Column:
    total = F.coalesce(values[0], F.lit(0))
    for value in values[1:]:
        total = total + F.coalesce(value, F.lit(0))
    return total


def chained_probabilities(top3: Column, top2: Column, win: Column) -> dict[str, Column]:
    """Top-3, then top-2 given top-3, then win given both; each rounded half-even to 3 places."""
    p3 = F.bround(top3, 3)
    p2 = F.bround(p3 * top2, 3)
    return {"top3": p3, "top2": p2, "win": F.bround(p3 * p2 * win, 3)}


def implied_odds(win: Column) -> Column:
    return (
        F.when(win.isNull(), F.lit(None).cast("double"))
        .when(win == 0, F.lit(float("inf")))
        .otherwise(F.bround(F.try_divide(F.lit(1.0), win) * PAYOUT_RATE, 3))
    )


def expected_place(*probabilities: Column) -> Column:
    """Sum of place number times probability, rounded half-even to 3 places."""
    total = probabilities[0]
    for place, p in enumerate(probabilities[1:], start=2):
        total = total + p * place
    return F.bround(total, 3)


def is_prime(n: Column) -> Column:
    """No divisor between 2 and n-1; 1 is not prime, 0 and negatives have no such divisor.

    Trial division by the odd numbers up to the square root, so run it on distinct values.
    """
    n = n.cast("bigint")
    root = F.floor(F.sqrt(F.abs(n).cast("double")))
    odd = F.when(n > 3, F.sequence(F.lit(3).cast("bigint"), F.greatest(root, F.lit(3)), F.lit(2).cast("bigint")))
    return (
        F.when(n == 1, F.lit(False))
        .when(n <= 3, F.lit(True))
        .when(n % 2 == 0, F.lit(False))
        .otherwise(~F.exists(odd, lambda k: (k < n) & (n % k == 0)))
    )
