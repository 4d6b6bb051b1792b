"""Candidate regions: measured, scored, elected, refined; statistics for the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.exprs import candidate_score, is_floored, nearest_rank, window_score
from tidemark.operators.intervals import in_regions, region_samples
from tidemark.operators.levels import ordered
from tidemark.operators.segments import quiet_run, refine


def speech_window_score(frame: Window) -> Column:
    mean = lambda c: F.avg(c).over(frame)
    return window_score({
        "kurtosis": mean("kurtosis"), "flatness": mean("flatness"), "centroid": mean("centroid"), "rms": mean("rms_level"), "rolloff": mean("rolloff"), "flux": mean("flux"),
        "kurtosis_variance": F.var_pop("kurtosis").over(frame), "voicing": F.avg((F.col("kurtosis") > C.VOICED_KURTOSIS).cast("double")).over(frame),
    })


def noise_region(intervals: DataFrame, flags: DataFrame, hop_s: int, window: tuple[int, int] = C.QUIET_WINDOW_HOPS) -> DataFrame:
    """The longest quiet run of each series, cut to its quietest window."""
    return refine(intervals, quiet_run(flags, hop_s), hop_s, *window, lambda frame: F.avg("rms_level").over(frame), lowest=True)


def room_tone_samples(intervals: DataFrame, regions: DataFrame) -> DataFrame:
    """The measures of each series' quiet region, with the crest: highest peak over mean level."""
    return region_samples(intervals, regions.select("series_id", "start", "end")).withColumn("crest", F.col("peak_level") - F.col("rms_level"))


def noise_profile(intervals: DataFrame, regions: DataFrame, floors: DataFrame, seconds_per_hop: float = C.FRAME_HOP_S, hop_s: int = 1) -> DataFrame:
    """(series_id, start, end, floor, peak_level, crest, entropy, warning); floors: (series_id, floor) replaces the mean level where there is one.

    The warning names a region shorter or longer than what is ideal, else null.
    """
    rows = room_tone_samples(intervals, regions).join(floors, "series_id", "left")
    low, high = C.ROOM_TONE_S
    s = (F.col("end") - F.col("start")) / hop_s * seconds_per_hop
    short = F.concat(F.format_string("using short room tone region (%.1fs)", s), F.lit(f" - ideally need >={low}s"))
    long = F.concat(F.format_string("using long room tone region (%.1fs)", s), F.lit(f" - ideally <={high}s"))
    return rows.select("series_id", "start", "end", F.coalesce("floor", "rms_level").alias("floor"), "peak_level", "crest", "entropy", F.when(s < low, short).when(s > high, long).alias("warning"))


def across_stages(stages: dict[str, DataFrame], regions: DataFrame) -> DataFrame:
    """Regions found on one stage, measured on the intervals of every stage."""
    return reduce(DataFrame.unionByName, (region_samples(iv, regions.select("series_id", "start", "end")).withColumn("stage", F.lit(name)) for name, iv in stages.items()))


def candidates(intervals: DataFrame, runs: DataFrame, floors: DataFrame, seconds_per_hop: float = C.FRAME_HOP_S, hop_s: int = 1) -> DataFrame:
    """Runs with their region sample and score. floors: (series_id, floor) where a noise region was found."""
    rows = region_samples(intervals, runs.select("series_id", "start", "end")).join(floors, "series_id", "left")
    seconds = (F.col("end") - F.col("start")) / hop_s * seconds_per_hop
    return rows.withColumn("score", F.round(candidate_score(F.col("rms_level"), F.col("floor"), seconds, F.col("level_variance")), 9))


def elect(scored: DataFrame) -> DataFrame:
    """The best candidate of each series: viable ones first, then by score, the earliest of equals."""
    by = Window.partitionBy("series_id").orderBy(F.desc((F.col("score") >= C.CANDIDATE_VIABLE).cast("int")), F.desc("score"), "start")
    return scored.withColumn("place", F.row_number().over(by)).where("place = 1").drop("place")


def elected_refined(intervals: DataFrame, elected: DataFrame, floors: DataFrame, hop_s: int, window: tuple[int, int] = C.SPEECH_WINDOW_HOPS, seconds_per_hop: float = C.FRAME_HOP_S) -> DataFrame:
    """Elected regions cut to their best speech window and measured again, with where they came from."""
    cut = refine(intervals, elected.select("series_id", "start", "end"), hop_s, *window, speech_window_score, lowest=False)
    again = candidates(intervals, cut.select("series_id", "start", "end"), floors, seconds_per_hop, hop_s)
    return again.join(cut, ["series_id", "start", "end"])


def gate_statistics(flags: DataFrame, regions: DataFrame, axis: str = "momentary") -> DataFrame:
    """A low percentile of speech in the elected region, a high one of all below the split, and what lies between."""
    noise = flags.groupBy("series_id").agg(ordered(F.col(axis), ~is_floored(F.col(axis)) & (F.col(axis) < F.col("split"))).alias("v"))
    voiced = in_regions(flags, regions.select("series_id", "start", "end")).groupBy("series_id").agg(ordered(F.col(axis), F.col("speech")).alias("w"))
    out = noise.join(voiced, "series_id", "left").select("series_id", nearest_rank(F.coalesce("w", F.array().cast("array<double>")), C.VOICED_PERCENTILE).alias("voiced_low"), nearest_rank(F.col("v"), C.NOISE_PERCENTILE).alias("noise_high"))
    return out.withColumn("separation", F.col("voiced_low") - F.col("noise_high"))
