"""Outcome means over a stream: an extension, batch and stream share one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import value_of


def windowed_outcomes(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, by, n, mean_value) of tumbling windows; rows later than ``late`` are left out by the stream."""
    v = value_of(value)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs an instant
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(v).alias("n"), F.avg(v).alias("mean_value"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), by, "n", "mean_value")
