"""Rounding that gives the same digits in every engine."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_round(x: Column, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: half goes up, whatever the engine's own rule is."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp01(x: Column) -> Column:
    """Into 0..1; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
