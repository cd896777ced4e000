"""Aggregate expressions with the library's exact definitions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def excess_kurtosis(x: Column) -> Column:
    """Bias-corrected above three values, biased up to three, 0 where undefined."""
    n, g2 = F.count(x).cast("double"), F.kurtosis(x)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.coalesce(F.when(F.count(x) > 3, corrected).otherwise(F.nanvl(g2, F.lit(None))), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL for constant input (the built-in raises there under ANSI)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mean_axis_correlation(x: Column, y: Column, z: Column) -> Column:
    """Mean absolute correlation over the axis pairs that have one, else 0."""
    pairs = F.array(*[F.abs(correlation(a, b)) for a, b in ((x, y), (x, z), (y, z))])
    known = F.filter(pairs, lambda r: r.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, r: acc + r)
    return F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))
