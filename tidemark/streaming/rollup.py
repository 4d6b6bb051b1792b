"""The interval roll-up as a stream: an extension of the batch operator, for unbounded event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import linear_to_db
from tidemark.operators.intervals import FULL_SCALE


def event_intervals(events: DataFrame, hop: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Closed intervals of a stream of events (event_type, ts timestamp, value); events later than late are dropped."""
    v = F.col("value")
    level = lambda x: F.round(linear_to_db(x / FULL_SCALE), 6)
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", hop), F.col("event_type").alias("series_id"))
    out = rows.agg(F.count("*").alias("n"), F.avg(v * v).alias("power"), F.max(F.abs(v)).alias("top"), F.avg(F.abs(v)).alias("mean"))
    return out.select("series_id", F.col("window.start").alias("ts"), "n", level(F.sqrt("power")).alias("rms_level"), level(F.col("top")).alias("peak_level"), level(F.col("mean")).alias("momentary"))
