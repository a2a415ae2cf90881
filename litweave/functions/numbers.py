"""Rounding with the semantics of IEEE doubles rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1: splits a double into two 26-bit halves


def round_exact(x: Column, digits: int) -> Column:
    """Round the binary value of `x`, ties to even.

    `round` works on the shortest decimal form and lifts every tie, `bround` too but to even, so
    each differs from the binary rule on some values. Here x * 10^digits is formed exactly as a
    sum of two doubles (product and its error term) and the fraction is compared with one half.
    """
    scale = float(10**digits)
    high = x * _SPLIT - (x * _SPLIT - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    base = F.floor(product).cast("double")
    above_half = (product - base) - 0.5  # exact; when it is not 0 it outweighs the error term
    odd = F.pmod(base, F.lit(2.0)) == 1
    up = (above_half > 0) | ((above_half == 0) & ((error > 0) | ((error == 0) & odd)))
    return F.when(up, base + 1).otherwise(base) / scale


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def order_score(score: Column) -> Column:
    """Score as a whole number of 1e-9 for sorting, so that summation order cannot split a tie."""
    return F.floor(score * 1e9 + 0.5)
