"""Level statistics of each series: seed, histogram, threshold, percentiles.

Every series is one aggregation group; what is collected within a group is one number an interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.exprs import clamp, clamp_split, finite_or, is_finite, is_floored, nearest_rank, upper_median


def ordered(column: Column, where: Column | None = None) -> Column:
    """The column's values in a group, ascending."""
    return F.sort_array(F.collect_list(column if where is None else F.when(where, column)))


def medians(intervals: DataFrame, axis: str = "momentary") -> DataFrame:
    """Upper medians of level and flux; floored values count, NaN comes first."""
    low = lambda c: F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(F.col(c))
    return intervals.groupBy("series_id").agg(upper_median(ordered(low(axis))).alias("level_p50"), upper_median(ordered(low("flux"))).alias("flux_p50"))


def room_tone_score(level: Column, flux: Column, level_p50: Column, flux_p50: Column) -> Column:
    quiet = F.when(level > level_p50, F.greatest(F.lit(0.0), 1.0 - (level - level_p50) / C.SEED_DECAY_DB)).otherwise(1.0)
    steady = F.when((flux_p50 > 0) & (flux > flux_p50), F.try_divide(flux_p50, flux)).otherwise(1.0)
    return C.SEED_WEIGHTS[0] * quiet + C.SEED_WEIGHTS[1] * steady


def noise_seed(intervals: DataFrame, axis: str = "momentary") -> DataFrame:
    """(series_id, seed, threshold): the loudest of the likeliest room-tone intervals, with a fallback for each reason."""
    scored = intervals.join(medians(intervals, axis), "series_id").withColumn("score", F.round(room_tone_score(F.col(axis), F.col("flux"), F.col("level_p50"), F.col("flux_p50")), 9))
    by = Window.partitionBy("series_id")
    ranked = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), axis, "ts"))).withColumn("n", F.count("*").over(by))
    most = F.least(F.col("n"), F.greatest(F.floor(F.col("n") / C.SEED_TOP), F.lit(C.SEED_LEAST_COUNT)))
    top = ranked.groupBy("series_id").agg(F.max(F.when((F.col("rank") <= most) & ~is_floored(F.col(axis)) & (F.col("n") >= C.SEED_LEAST_INTERVALS), F.col(axis))).alias("seed"))
    return top.select("series_id", F.coalesce("seed", F.lit(C.FLOORED_DB)).alias("seed"), (F.col("seed") + C.SEED_HEADROOM_DB).alias("threshold"))


def histogram(intervals: DataFrame, axis: str = "momentary", width: float = C.BIN_WIDTH_DB) -> DataFrame:
    """(series_id, bin, n, low, high) of the levels that are not floored; low and high are the series' extremes."""
    kept = intervals.where(~is_floored(F.col(axis)))
    ends = kept.groupBy("series_id").agg(F.min(axis).alias("low"), F.max(axis).alias("high"))
    index = F.floor((F.col(axis) - F.col("low")) / width)
    return kept.join(ends, "series_id").groupBy("series_id", F.least(index, F.floor((F.col("high") - F.col("low")) / width)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("low").alias("low"), F.min("high").alias("high"))


def otsu(bins: DataFrame, width: float = C.BIN_WIDTH_DB) -> DataFrame:
    """(series_id, split, low, high): the upper edge of the bin after which the variance between the classes is largest.

    Empty bins change no sum, so only bins that hold levels take part; the first largest variance wins. With one class
    only the split is the middle.
    """
    centre = F.col("low") + (F.col("bin") + 0.5) * width
    w = Window.partitionBy("series_id").orderBy("bin")
    every = Window.partitionBy("series_id")
    run = bins.withColumn("m", centre * F.col("n")).select("series_id", "bin", "low", "high", F.sum("n").over(w).alias("wb"), F.sum("m").over(w).alias("sb"), F.sum("n").over(every).alias("wt"), F.sum("m").over(every).alias("st"))
    wf = F.col("wt") - F.col("wb")
    diff = F.col("sb") / F.col("wb") - (F.col("st") - F.col("sb")) / F.nullif(wf, F.lit(0))
    between = F.when(wf > 0, F.col("wb") * wf * diff * diff)
    best = run.withColumn("v", F.round(between, 6)).groupBy("series_id", "low", "high").agg(F.max(F.when(F.col("v") > 0, F.struct("v", -F.col("bin")))).alias("best"))
    found = F.col("low") + (F.lit(1) - F.col("best").getItem("col2")) * width
    return best.select("series_id", F.coalesce(found, (F.col("low") + F.col("high")) / 2).alias("split"), "low", "high")


def thresholds(intervals: DataFrame, axis: str = "momentary") -> DataFrame:
    """Each series' seed, raw and clamped split, floor, upper mode, hysteresis margin and floored share."""
    bins = histogram(intervals, axis)
    levels = intervals.groupBy("series_id").agg(
        ordered(F.col(axis), ~is_floored(F.col(axis))).alias("levels"),
        F.avg(F.coalesce(F.isnan(axis) | (F.col(axis) <= C.FLOORED_DB), F.lit(False)).cast("double")).alias("floored_share"),
    )
    levels = levels.select("series_id", nearest_rank(F.col("levels"), C.CLAMP_PERCENTILE).alias("p75"), nearest_rank(F.col("levels"), C.FLOOR_PERCENTILE).alias("p10"), "floored_share")
    base = levels.join(noise_seed(intervals, axis), "series_id").join(otsu(bins), "series_id", "left")
    base = base.select(
        "series_id", "seed", F.coalesce("split", F.lit(0.0)).alias("raw_split"), clamp_split(F.coalesce("split", F.lit(0.0)), F.col("seed"), F.col("p75")).alias("split"),
        F.greatest(F.col("p10"), F.col("seed") + C.NOISE_MARGIN_DB).alias("floor"), "floored_share", (F.col("floored_share") >= C.VOICE_ACTIVATED_SHARE).alias("voice_activated"),
    )
    centre = F.col("low") + (F.col("bin") + 0.5) * C.BIN_WIDTH_DB
    upper = bins.join(base.select("series_id", "split"), "series_id").where(centre >= F.col("split")).groupBy("series_id").agg((F.sum(centre * F.col("n")) / F.sum("n")).alias("upper"))
    out = base.join(upper, "series_id", "left").withColumn("upper_mode", F.coalesce("upper", "split")).drop("upper")
    distance = F.col("upper_mode") - F.col("split")
    return out.withColumn("margin", F.when(distance > 0, distance * C.HYSTERESIS_SHARE).otherwise(C.HYSTERESIS_FALLBACK_DB))


def interval_summary(intervals: DataFrame, column: str = "rms_level") -> DataFrame:
    """Count, and from 10 measured levels on: lowest, percentiles by whole-number index, and the widest gap with its edges."""
    levels = ordered(F.col(column), F.col(column) > C.SILENCE_DB)
    at = lambda top, bottom: F.get("v", F.floor(F.size("v") * top / bottom).cast("int"))
    one = intervals.groupBy("series_id").agg(F.count("*").alias("intervals"), levels.alias("v")).withColumn("v", F.when(F.size("v") >= 10, F.col("v")))
    gap = F.expr("array_max(transform(slice(v, 2, size(v)), (x, i) -> struct(x - v[i] AS gap, -i AS at, v[i] AS low, x AS high)))")
    one = one.withColumn("widest", F.when(F.col("v").isNotNull(), gap))
    return one.select("series_id", "intervals", F.array_min("v").alias("lowest"), *(at(t, b).alias(n) for n, t, b in (("p10", 1, 10), ("p25", 1, 4), ("p50", 1, 2), ("p75", 3, 4), ("p90", 9, 10))), F.col("widest.gap").alias("widest_gap"), F.col("widest.low").alias("gap_low"), F.col("widest.high").alias("gap_high"))


def noise_floor(measured: DataFrame) -> DataFrame:
    """Adds floor, floor_source and reduction_headroom to rows with rms_trough, rms_level, integrated and threshold."""
    known = lambda c: is_finite(F.col(c)) & (F.col(c) != 0)
    tier = lambda values: F.when(F.col("integrated") > C.TIER_LUFS[0], values[0]).when(F.col("integrated") > C.TIER_LUFS[1], values[1]).otherwise(values[2])
    floor = F.when(known("rms_trough"), F.col("rms_trough")).when(known("rms_level"), F.col("rms_level") - C.RMS_FLOOR_OFFSET_DB).otherwise(F.col("threshold") - tier(C.TIER_OFFSET_DB))
    source = F.when(known("rms_trough"), "levels").when(known("rms_level"), "rms_estimate").otherwise("loudness_estimate")
    out = measured.withColumn("floor", clamp(finite_or(floor, C.NOISE_FLOOR_DB[0]), *C.NOISE_FLOOR_DB)).withColumn("floor_source", source)
    return out.withColumn("reduction_headroom", F.when((F.col("rms_level") != 0) & (F.col("floor") != 0), clamp(F.col("rms_level") - F.col("floor"), 0, 60)).otherwise(tier(C.TIER_HEADROOM_DB)))
