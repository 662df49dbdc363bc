"""Statistics as column expressions, with the same arithmetic as their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95, scale: float = 1.0, digits: int = 4) -> tuple[Column, Column]:
    """Both ends of the Wilson score interval, times ``scale``; null for an empty total."""
    n = total.cast("double")
    p = successes.cast("double") / n
    center = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = total > 0
    low = F.when(some, F.round(F.greatest(center - half, F.lit(0.0)) * scale, digits))
    high = F.when(some, F.round(F.least(center + half, F.lit(1.0)) * scale, digits))
    return low, high


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    t = 1 / (1 + x * 0.3275911)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


ERFC_SQL = (
    "((1/(1+({x})*0.3275911)) * (0.254829592 + (1/(1+({x})*0.3275911)) * (-0.284496736 + (1/(1+({x})*0.3275911)) * "
    "(1.421413741 + (1/(1+({x})*0.3275911)) * (-1.453152027 + (1/(1+({x})*0.3275911)) * 1.061405429)))) * exp(-({x})*({x})))"
)


def yates_chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2x2 table with Yates' correction; null where a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.when(margins > 0, n * gap * gap / margins)


def average_rank(value_rank: Column, ties: Column) -> Column:
    """Rank shared by ties: the first rank of the tie plus half of those that follow."""
    return value_rank + (ties - 1) / 2.0
