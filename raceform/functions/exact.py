"""Sums that do not depend on row order: values are counted in whole units of ``10**-decimals``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Squares are added in three limbs of so many bits; sums of limbs stay whole numbers up to 4e12 rows.
LIMB_BITS = 21
# Largest value whose square is a 64-bit number.
LARGEST_PLAIN = 3_037_000_499


def units(c: Column, decimals: int) -> Column:
    return F.round(c * 10**decimals).cast("bigint") if decimals else c.cast("bigint")


def _widened(parts: list[Column]) -> Column:
    """High, middle and low sums, and the decimal sum of what is not in them."""
    *limbs, big = parts
    total = F.coalesce(big, F.lit(0).cast("decimal(38,0)"))
    for i, limb in enumerate(reversed(limbs)):
        total = total + limb.cast("decimal(20,0)") * F.lit(2 ** (LIMB_BITS * i))
    return total.cast("decimal(38,0)")


def sum_of_squares(u: Column) -> Column:
    """Sum of squares of whole numbers, added in whole-number limbs and widened at the end; the sum must stay below 1e38.

    Much cheaper than adding decimals, which only values beyond ``LARGEST_PLAIN`` need.
    """
    plain = u.between(-LARGEST_PLAIN, LARGEST_PLAIN)
    square = F.when(plain, u * u).when(~plain, F.lit(0).cast("bigint"))
    mask = F.lit(2**LIMB_BITS - 1)
    wide = u.cast("decimal(19,0)")
    return _widened([
        F.sum(F.shiftright(square, 2 * LIMB_BITS)), F.sum(F.shiftright(square, LIMB_BITS).bitwiseAND(mask)),
        F.sum(square.bitwiseAND(mask)), F.sum(F.when(~plain, wide * wide)),
    ])
