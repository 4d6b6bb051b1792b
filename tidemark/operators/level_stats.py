"""Statistics of a sampled signal: levels, trough and crest, floor, flatness of the extremes, offset, crossings.

Samples are (series_id, i, x) with i dense from 0. Counts, sums and extremes are partial aggregations; differences and
crossings look one sample back, by chunks. Levels are in decibels of full scale, -inf for silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chunks import chunked

CHUNK = 1 << 20


def decibels(x: Column) -> Column:
    return F.when(x > 0, 20 * F.log10(x)).otherwise(F.when(x.isNotNull(), float("-inf")))


def windows(samples: DataFrame, size: int) -> DataFrame:
    """(series_id, window, rms, peak) of consecutive windows of size samples; the last may be shorter."""
    return samples.groupBy("series_id", F.floor(F.col("i") / size).alias("window")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))


def flat_runs(samples: DataFrame, extremes: DataFrame) -> DataFrame:
    """(series_id, flat): squared lengths of the runs at the lowest and highest value by how often these occur."""
    at = samples.join(extremes.select("series_id", "low", "high"), "series_id").where("x = low OR x = high")
    by = Window.partitionBy("series_id", "x").orderBy("i")
    runs = at.withColumn("run", F.col("i") - F.row_number().over(by)).groupBy("series_id", "x", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("series_id").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("flat"))


def level_statistics(samples: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """One row a series; window: samples of 50 ms."""
    x = F.col("x")
    whole = samples.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg("x").alias("dc_offset"), F.min("x").alias("low"), F.max("x").alias("high"), F.sqrt(F.avg(x * x)).alias("rms"),
        F.max(F.abs(x)).alias("peak"), F.min(F.when(x != 0, F.abs(x))).alias("least"),
    )
    parts = windows(samples, window).groupBy("series_id").agg(F.min("rms").alias("trough"), F.max("rms").alias("loudest"), F.min("peak").alias("quietest"))
    before = F.lag("x").over(Window.partitionBy("series_id", "chunk").orderBy("i"))
    steps = chunked(samples, "i", chunk, 1).withColumn("before", before).where("own AND before IS NOT NULL").withColumn("d", F.abs(x - F.col("before")))
    steps = steps.groupBy("series_id").agg(F.min("d").alias("min_difference"), F.max("d").alias("max_difference"), F.avg("d").alias("mean_difference"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms_difference"), F.sum((F.signum("x") * F.signum("before") < 0).cast("long")).alias("zero_crossings"))
    out = whole.join(parts, "series_id").join(steps, "series_id", "left").join(flat_runs(samples, whole), "series_id")
    c = F.col
    return out.select(
        "series_id", c("n").alias("samples"), "dc_offset", c("low").alias("min_level"), c("high").alias("max_level"), "min_difference", "max_difference", "mean_difference", "rms_difference",
        decibels(c("peak")).alias("peak_db"), decibels(c("rms")).alias("rms_db"), decibels(c("trough")).alias("rms_trough_db"), decibels(c("loudest")).alias("rms_peak_db"),
        F.when(c("rms") > 0, decibels(c("peak") / c("rms"))).otherwise(0.0).alias("crest_db"), decibels(2 * c("peak") / c("least")).alias("dynamic_range_db"), decibels(c("quietest")).alias("noise_floor_db"),
        decibels(c("flat")).alias("flat_factor_db"), F.coalesce("zero_crossings", F.lit(0)).cast("long").alias("zero_crossings"), (F.coalesce("zero_crossings", F.lit(0)) / c("n")).alias("zero_crossing_rate"),
    )
