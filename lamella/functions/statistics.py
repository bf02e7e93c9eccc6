"""Aggregates with the engine's conventions: missing values skipped, moments as stated, exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import finite

EPS = 1e-9


def skew_corrected(c: Column) -> Column:
    """Sample skewness with bias correction; null for fewer than three values or no spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(c))


def kurtosis_corrected(c: Column) -> Column:
    """Excess kurtosis with bias correction; null for fewer than four values or no spread."""
    n = F.count(c).cast("double")
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def nine_parts(prefix: str, column: str) -> list[tuple[str, Column]]:
    """Names and values of the nine numbers."""
    c = finite(F.col(column))
    q = lambda p: F.percentile(c, F.lit(p))
    parts = {"mean": F.avg(c), "median": q(0.5), "std": F.stddev_pop(c), "skew": skew_corrected(c), "kurtosis": kurtosis_corrected(c), "min": F.min(c), "max": F.max(c), "p10": q(0.1), "p90": q(0.9)}
    return [(f"{prefix}_{k}", v) for k, v in parts.items()]


def nine_numbers(prefix: str, column: str) -> list[Column]:
    """Mean, median, spread, shape, range and outer deciles of a column's finite values; a group's percentiles come from one task."""
    return [v.alias(k) for k, v in nine_parts(prefix, column)]


def circular_variance(angle: Column) -> Column:
    """Of axes: one minus the mean resultant of doubled angles."""
    a = finite(angle)
    return 1 - F.sqrt(F.pow(F.avg(F.cos(2 * a)), 2) + F.pow(F.avg(F.sin(2 * a)), 2))
