"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column | str, decimals: int = 6) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` — decided on the binary value, so every
    engine that evaluates the same formula rounds ties the same way."""
    c = F.col(c) if isinstance(c, str) else c
    k = float(10 ** decimals)
    return (F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)).cast("double")


def floor_div(c: Column, n: int | Column) -> Column:
    """``floor(c / n)`` of whole numbers, exactly: a nanosecond epoch has more digits than a double."""
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    return F.call_function("div", c - F.pmod(c, n), n)
