"""Windowed moments over a stream: the grouped statistics with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, time: str, value: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Works on batch and streaming frames; on streams, groups close when the watermark passes them."""
    x = F.col(value)
    g = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return g.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var0")).select(F.col("w.start").alias("window_start"), *keys, "n", "mean", "var0")
