"""The counting operators over streams: results grow with the cells read, so complete or update mode keeps them right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_counts(stream: DataFrame, by: list[str], value: str) -> DataFrame:
    return stream.groupBy(*by, value).agg(F.count("*").alias("n"))


def pivoted_counts(stream: DataFrame, by: list[str], value: str, values: list) -> DataFrame:
    """Zero-filled columns without pivot, which streams lack."""
    return stream.groupBy(*by).agg(*[F.count(F.when(F.col(value) == v, 1)).alias(str(v)) for v in values])


def windowed_counts(stream: DataFrame, ts: str, by: list[str], late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Cells a window, late ones up to the watermark; append mode."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
