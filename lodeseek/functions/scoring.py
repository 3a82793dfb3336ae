"""Similarity and rank functions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

RRF_K = 60


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length, in double; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.slice(v.cast("array<double>"), F.lit(1), n) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / norms).otherwise(0.0)


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Reciprocal-rank fusion: the sum of 1/(k+rank) over the ranks there are."""
    return sum((F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def min_max_best_low(score: Column, over: WindowSpec) -> Column:
    """The score scaled so that the lowest becomes 1 and the highest 0; 1 for all where they are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(score.isNull(), None).when(low == high, 1.0).otherwise((high - score) / (high - low))


def fixed3(x: Column) -> Column:
    """A number as text with three decimals."""
    return F.format_string("%.3f", x)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding as floor(x * 10^digits + 0.5)."""
    f = 10.0**digits
    return F.floor(x * F.lit(f) + F.lit(0.5)) / F.lit(f)
