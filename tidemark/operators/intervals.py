"""Interval rows from raw events or frames, and aggregates over ranges of them.

An interval table has series_id, ts and one column a measure. All operators keep the series apart, so a corpus of any
number of series spreads over the cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import SILENCE_DB
from tidemark.functions.exprs import linear_to_db

FULL_SCALE = 500.0
FEATURES = ("rms_level", "peak_level", "momentary", "centroid", "entropy", "kurtosis", "flatness", "rolloff", "flux")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zoneless timestamp, whatever the session's time zone."""
    return F.datediff(ts, F.lit("1970-01-01")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def event_intervals(events: DataFrame, hop_s: int = 3600) -> DataFrame:
    """Tumbling intervals of each event type: levels of the values and features of who sent them.

    One partial and one final hash aggregation; nothing is ordered. Levels are rounded to 6 decimals so that the sum's
    order decides no threshold.
    """
    v, u = F.col("value"), F.col("user_id")
    slot = F.floor(epoch_seconds(F.col("ts")) / hop_s).cast("long") * hop_s
    sums = events.where("event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").groupBy(F.col("event_type").alias("series_id"), slot.alias("ts"))
    mean = lambda m, by: F.avg(u % m) * by
    out = sums.agg(
        F.count("*").alias("n"), F.avg(v * v).alias("power"), F.max(F.abs(v)).alias("top"), F.avg(F.abs(v)).alias("mean"),
        mean(97, 100.0).alias("centroid"), mean(10, 0.08).alias("entropy"), mean(13, 1.0).alias("kurtosis"),
        mean(7, 0.1).alias("flatness"), (mean(89, 100.0) + 1000.0).alias("rolloff"), mean(31, 0.001).alias("flux"),
    )
    level = lambda x: F.round(linear_to_db(x / FULL_SCALE), 6)
    return out.select("series_id", "ts", "n", level(F.sqrt("power")).alias("rms_level"), level(F.col("top")).alias("peak_level"), level(F.col("mean")).alias("momentary"), *(F.round(c, 9).alias(c) for c in FEATURES[3:]))


def frame_intervals(frames: DataFrame, hop_s: float = 0.25) -> DataFrame:
    """Tumbling intervals of frames (series_id, start_s, sum_squares, samples, peak, <features>): levels from sums, features averaged."""
    features = [c for c in frames.columns if c not in ("series_id", "start_s", "sum_squares", "samples", "peak")]
    ts = (F.floor(F.col("start_s") / hop_s) * hop_s).alias("ts")
    out = frames.groupBy("series_id", ts).agg(F.count("*").alias("frames"), F.sum("sum_squares").alias("ss"), F.sum("samples").alias("ns"), F.max("peak").alias("peak"), *(F.avg(c).alias(c) for c in features))
    rms = F.sqrt(F.col("ss") / F.nullif(F.col("ns"), F.lit(0)))
    return out.select("series_id", "ts", "frames", F.when(rms < 1e-5, F.lit(SILENCE_DB)).otherwise(linear_to_db(F.coalesce(rms, F.lit(0.0)))).alias("rms_level"), linear_to_db(F.col("peak")).alias("peak_level"), *features)


def greedy_intervals(frames: DataFrame, hop_s: float = 0.25) -> DataFrame:
    """Intervals that close at the first frame starting hop_s or more after the interval's start.

    The closing frame's levels belong to the closed interval, the next one starts at that frame's start; a partial one at
    the end is kept. Sequential within a series, so one series is one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_s", kind="stable")
        rows, begin, ss, ns, peak, n = [], 0.0, 0.0, 0, 0.0, 0
        for start, s, k, p in zip(pdf["start_s"], pdf["sum_squares"], pdf["samples"], pdf["peak"]):
            ss, ns, peak, n = ss + s, ns + k, max(peak, p), n + 1
            if start - begin >= hop_s:
                rows.append((begin, n, ss, ns, peak))
                begin, ss, ns, peak, n = start, 0.0, 0, 0.0, 0
        if n:
            rows.append((begin, n, ss, ns, peak))
        out = pd.DataFrame(rows, columns=["ts", "frames", "ss", "ns", "peak"])
        out.insert(0, "series_id", pdf["series_id"].iloc[0])
        return out

    closed = frames.groupBy("series_id").applyInPandas(fold, "series_id string, ts double, frames long, ss double, ns long, peak double")
    rms = F.sqrt(F.col("ss") / F.nullif(F.col("ns"), F.lit(0)))
    return closed.select("series_id", "ts", "frames", F.when(rms < 1e-5, F.lit(SILENCE_DB)).otherwise(linear_to_db(F.coalesce(rms, F.lit(0.0)))).alias("rms_level"), linear_to_db(F.col("peak")).alias("peak_level"))


def in_regions(intervals: DataFrame, regions: DataFrame, bin_s: int = 86400) -> DataFrame:
    """Interval rows with the regions (series_id, start, end) that hold them, half-open.

    An equi join on (series, time bin): a region is listed once for each bin it touches, so there is no range join.
    """
    bins = F.sequence(F.floor(F.col("start") / bin_s), F.floor((F.col("end") - 1) / bin_s))
    listed = regions.where(F.col("end") > F.col("start")).withColumn("bin", F.explode(bins))
    rows = intervals.withColumn("bin", F.floor(F.col("ts") / bin_s))
    return rows.join(listed, ["series_id", "bin"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).drop("bin")


def region_samples(intervals: DataFrame, regions: DataFrame) -> DataFrame:
    """Means of the measures over each region, the highest peak, the voicing density and the level variance."""
    keys = [c for c in regions.columns]
    rows = in_regions(intervals, regions).groupBy(*keys)
    means = [F.avg(c).alias(c) for c in FEATURES if c != "peak_level"]
    return rows.agg(F.count("*").alias("intervals"), F.greatest(F.lit(SILENCE_DB), F.max("peak_level")).alias("peak_level"), F.avg((F.col("kurtosis") > 4.5).cast("double")).alias("voicing"), F.var_pop("momentary").alias("level_variance"), *means)
