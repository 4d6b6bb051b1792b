"""Queries over the driver's tables and the same in SQL, as an independent check.

Series are the event types, intervals are hours, durations count in hours. Floating results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import exprs as X
from tidemark.operators import election, intervals, level_stats, levels, loudness, segments, spectral
from tidemark.plans import record, scores, tuning

HOP_S = 3600
RUN_HOPS = 4
GAP_HOPS = (2, 10)
QUIET_HOPS = (6, 4)
SPEECH_HOPS = (12, 6)
SECONDS_PER_HOP = 2.0
DIM, WIDTH = 64, 50
RATE_HZ = 16_000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded; a nudge far below the digits keeps exact halves from falling either way."""
    return df.select(*(F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


class Detector:
    """The detector's tables for one input. What several of them read is persisted, so events are read once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.iv = intervals.event_intervals(read(spark, sf_dir, "events"), HOP_S).persist()

    @cached_property
    def limits(self) -> DataFrame:
        return levels.thresholds(self.iv).persist()

    @cached_property
    def flags(self) -> DataFrame:
        return segments.speech_flags(self.iv, self.limits).persist()

    @property
    def tolerance(self) -> DataFrame:
        return segments.gap_tolerance(self.flags, GAP_HOPS)

    @cached_property
    def runs(self) -> DataFrame:
        return segments.speech_runs(self.flags, self.tolerance, HOP_S, RUN_HOPS).persist()

    @property
    def noise(self) -> DataFrame:
        return election.noise_region(self.iv, self.flags, HOP_S, QUIET_HOPS)

    @property
    def floors(self) -> DataFrame:
        return self.limits.join(segments.quiet_run(self.flags, HOP_S).select("series_id"), "series_id", "left_semi").select("series_id", "floor")

    @property
    def candidates(self) -> DataFrame:
        return election.candidates(self.iv, self.runs, self.floors, SECONDS_PER_HOP, HOP_S)

    @cached_property
    def elected(self) -> DataFrame:
        return election.elect(self.candidates).persist()


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings end to end, WIDTH of them a series, as a sampled signal."""
    rows = read(spark, sf_dir, "embeddings").where(f"size(embedding) = {DIM}").select("vec_id", F.posexplode("embedding").alias("place", "x"))
    return rows.select(F.floor(F.col("vec_id") / WIDTH).cast("string").alias("series_id"), (F.col("vec_id") % WIDTH * DIM + F.col("place")).alias("i"), F.round(F.col("x").cast("double") / 4, 6).alias("x"))


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squares of blocks of DIM samples of the signal, at a loudness that falls from block to block and starts again."""
    z = signal(spark, sf_dir).groupBy("series_id", F.floor(F.col("i") / DIM).alias("block")).agg(F.avg(F.col("x") * F.col("x")).alias("z"))
    return z.withColumn("z", F.col("z") * F.pow(F.lit(10.0), -(F.col("block") % 9)))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of the embeddings as spectra, the label as series."""
    rows = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.col("label").cast("string").alias("series_id"), "vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("spectrum"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_statistics(spectra(spark, sf_dir), RATE_HZ, "vec_id")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer with made-up measurements from its orders, for the decision operators."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(F.count("*").alias("n"), (F.sum(F.col("o_orderkey") % 1000)).alias("s"))
    part = lambda m, low, high: F.lit(low) + (F.col("s") % m) * F.lit((high - low) / m)
    return o.select(
        "series_id", part(97, -45.0, -8.0).alias("integrated"), part(89, -20.0, 2.0).alias("peak"), part(83, 2.0, 25.0).alias("range_lu"),
        part(79, -90.0, -30.0).alias("floor"), part(73, -60.0, -20.0).alias("voiced_low"), part(71, 0.0, 40.0).alias("separation"),
        part(67, -40.0, 0.0).alias("body_db"), part(61, -40.0, 0.0).alias("sibilant_db"), part(59, -45.0, -10.0).alias("speech_rms"), part(53, -50.0, -12.0).alias("file_rms"),
        part(47, 5.0, 30.0).alias("room_crest"), part(43, -60.0, -20.0).alias("room_peak"), part(41, 0.0, 1.0).alias("room_flatness"), part(37, -70.0, -20.0).alias("rms_trough"),
        (F.col("s") % 5 != 0).alias("has_speech"), (F.col("s") % 7 != 0).alias("has_bands"), (F.col("s") % 11 == 0).alias("voice_activated"),
        F.transform(F.sequence(F.lit(0), F.lit(14)), lambda b: F.when((F.col("s") + b) % 17 == 0, F.lit(float("nan"))).otherwise(F.lit(-60.0) + ((F.col("s") * (b + 1)) % 31))).alias("band_levels"),
    )


def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.tune(measured(spark, sf_dir).withColumn("peak_level", F.col("peak")))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measured(spark, sf_dir).select("series_id", F.col("integrated").alias("out_integrated"), F.col("peak").alias("out_peak"), F.col("integrated").alias("measured_integrated"), F.col("peak").alias("measured_peak"), (F.col("integrated") + F.col("range_lu") / 25).alias("final_integrated"), F.when(F.col("has_bands"), " Linear").otherwise(" Dynamic ").alias("mode"))
    return tuning.normalisation(tuning.linear_target(tuning.limiter_plan(df)))


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each series by stage: intervals of the first, second and third eight hours of a day stand for the stages."""
    iv = intervals.event_intervals(read(spark, sf_dir, "events"), HOP_S)
    stage = F.element_at(F.array(F.lit("input"), F.lit("filtered"), F.lit("final")), (F.floor(F.col("ts") % 86400 / 28800) + 1).cast("int"))
    return iv.groupBy("series_id", stage.alias("stage")).agg(*(F.round(F.avg(m[0]) + 3e-11, 6).alias(m[0]) for m in record.METRICS))


def q_scalar(spark, sf_dir):
    m = measured(spark, sf_dir)
    p = F.col("peak")
    return rounded(m.select("series_id", X.db_to_linear(p).alias("linear"), X.linear_to_db(p).alias("db"), X.sample_to_db(p * 100).alias("sample_db"), X.linear_score(p, -6, -1).alias("score"), X.loudness_tier(F.col("integrated")).alias("tier"), X.silence_threshold(F.col("floor")).alias("silence"), X.hops((F.col("range_lu") * 1000).cast("long"), F.lit(250)).alias("hops"), X.rolloff_score(F.col("range_lu") * 500).alias("rolloff"), X.flux_score(F.col("range_lu") / 700).alias("flux"), X.snr_score(F.col("separation")).alias("snr"), scores.gain_position(p).alias("place")))


def q_formats(spark, sf_dir):
    m = measured(spark, sf_dir)
    x = F.col("integrated")
    return m.select("series_id", X.metric_db(x * 3).alias("db"), X.metric_lufs(x * 2).alias("lufs"), X.metric_signed(F.col("peak")).alias("signed"), X.duration_text(F.col("range_lu") * 300).alias("duration"), X.channel_name((F.col("range_lu") / 7).cast("int")).alias("channels"), X.gain_message(F.col("peak")).alias("advice"), record.output_name(F.concat(F.lit("s"), F.col("series_id")), x).alias("name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "interval_rollup": lambda s, d: Detector(s, d).iv,
    "silence_medians": lambda s, d: levels.medians(Detector(s, d).iv),
    "noise_floor_seed": lambda s, d: rounded(levels.noise_seed(Detector(s, d).iv)),
    "level_histogram": lambda s, d: levels.histogram(Detector(s, d).iv),
    "otsu_split": lambda s, d: rounded(levels.otsu(levels.histogram(Detector(s, d).iv))),
    "thresholds": lambda s, d: rounded(Detector(s, d).limits),
    "interval_summary": lambda s, d: rounded(levels.interval_summary(Detector(s, d).iv)),
    "speech_flags": lambda s, d: Detector(s, d).flags.select("series_id", "ts", "speech"),
    "gap_tolerance": lambda s, d: Detector(s, d).tolerance,
    "speech_runs": lambda s, d: Detector(s, d).runs,
    "longest_quiet_run": lambda s, d: segments.quiet_run(Detector(s, d).flags, HOP_S),
    "noise_region": lambda s, d: Detector(s, d).noise,
    "region_samples": lambda s, d: rounded((x := Detector(s, d)) and intervals.region_samples(x.iv, x.runs.select("series_id", "start", "end")), 9, 3e-11),
    "candidate_scores": lambda s, d: rounded(Detector(s, d).candidates.select("series_id", "start", "end", "score")),
    "elected_region": lambda s, d: rounded(Detector(s, d).elected.select("series_id", "start", "end", "score")),
    "refined_region": lambda s, d: (x := Detector(s, d)) and rounded(election.elected_refined(x.iv, x.elected, x.floors, HOP_S, SPEECH_HOPS, SECONDS_PER_HOP).select("series_id", "start", "end", "refined", "original_start", "original_end", "score")),
    "gate_statistics": lambda s, d: (x := Detector(s, d)) and rounded(election.gate_statistics(x.flags, x.elected)),
    "noise_profile": lambda s, d: (x := Detector(s, d)) and rounded(election.noise_profile(x.iv, x.noise, x.floors, SECONDS_PER_HOP, HOP_S)),
    "room_tone_samples": lambda s, d: (x := Detector(s, d)) and rounded(election.room_tone_samples(x.iv, x.noise).select("series_id", "rms_level", "peak_level", "crest", "momentary", "entropy", "centroid"), 9, 3e-11),
    "region_stages": lambda s, d: (x := Detector(s, d)) and rounded(election.across_stages({k: x.iv.withColumn("momentary", F.col("momentary") + g) for k, g in (("input", 0.0), ("filtered", 3.0), ("final", 6.0))}, x.elected).select("series_id", "stage", "intervals", "momentary", "rms_level"), 9, 3e-11),
    "candidate_counts": lambda s, d: Detector(s, d).runs.groupBy("series_id").agg(F.count("*").alias("candidates")),
    "level_statistics": lambda s, d: rounded(level_stats.level_statistics(signal(s, d), 160, 1000), 6, 3e-8),
    "loudness_curve": lambda s, d: rounded(loudness.loudness_curve(energies(s, d), 40).select("series_id", "block", "momentary", "short_term"), 6, 3e-8),
    "programme_loudness": lambda s, d: rounded(loudness.programme_loudness(loudness.loudness_curve(energies(s, d), 40)), 6, 3e-8),
    "signal_loudness": lambda s, d: loudness.programme_loudness(loudness.loudness_curve(loudness.energy_blocks(signal(s, d), 640))).join(loudness.true_peak(signal(s, d), 640), "series_id"),
    "spectral_moments": lambda s, d: rounded(statistics(s, d).select("vec_id", "mean", "variance", "centroid", "spread", "skewness", "kurtosis")),
    "spectral_shape": lambda s, d: rounded(statistics(s, d).select("vec_id", "entropy", "flatness", "crest", "slope", "decrease", "rolloff")),
    "spectral_flux": lambda s, d: rounded(statistics(s, d).select("vec_id", "flux")),
    "region_spectral_mean": lambda s, d: rounded(statistics(s, d).groupBy("series_id").agg(*(F.avg(c).alias(c) for c in ("centroid", "entropy", "flatness", "crest")))),
    "scalar_functions": q_scalar,
    "text_formats": q_formats,
    "input_noise_floor": lambda s, d: rounded(levels.noise_floor(measured(s, d).select("series_id", F.when(F.col("has_speech"), F.col("rms_trough")).otherwise(0.0).alias("rms_trough"), F.when(F.col("has_bands"), F.col("file_rms")).otherwise(0.0).alias("rms_level"), "integrated", (F.col("integrated") - 10).alias("threshold"))).select("series_id", "floor", "floor_source", "reduction_headroom")),
    "adaptive_denoise": lambda s, d: rounded(tuned(s, d).select("series_id", "denoise_on", "denoise_floor", "track_noise", "noise_type")),
    "adaptive_gate": lambda s, d: rounded(tuned(s, d).select("series_id", "gate_threshold_db", "gate_unclamped_db", "gate_ratio", "gate_depth_db", "gate_reason", "gate_headroom_db")),
    "adaptive_deesser": lambda s, d: rounded(tuned(s, d).select("series_id", "deess_intensity")),
    "adaptive_compressor": lambda s, d: rounded(tuned(s, d).select("series_id", "compressor_threshold_db")),
    "filter_spec": lambda s, d: tuned(s, d).select("series_id", tuning.chain_text(("downmix", "rumble", "band_limit", "gate", "compressor", "deesser", "resample")).alias("spec")),
    "filter_chain": lambda s, d: tuned(s, d).select("series_id", tuning.chain_text().alias("spec")),
    "limiter_plan": lambda s, d: rounded(planned(s, d).select("series_id", "gain_db", F.col("limit").alias("needed"), "limit_clamped", "pre_gain_db", "ceiling_db")),
    "linear_target": lambda s, d: rounded(planned(s, d).select("series_id", "inner_peak_db", "linear", "target_lufs", "offset_db", "emitted_peak_db", "brickwall_db")),
    "normalisation_result": lambda s, d: rounded(planned(s, d).select("series_id", "status", "deviation_lu", "within_target", "varied")),
    "recording_score": lambda s, d: rounded(measured(s, d).select("series_id", scores.recording_score(F.col("peak"), F.col("integrated"), F.col("range_lu"), F.col("floor"), F.when(F.col("has_speech"), F.col("speech_rms"))).alias("score")).withColumn("score", F.round("score", 6)).withColumn("stars", X.stars(F.col("score"))).withColumn("label", X.star_label(F.col("score")))),
    "quality_score": lambda s, d: rounded(measured(s, d).select("series_id", scores.quality_score(F.col("integrated"), F.lit(0.0), [F.when(F.col("has_bands"), F.col("peak"))], [F.when(F.col("has_speech"), F.col("floor"))]).alias("score"))),
    "gain_advice": lambda s, d: measured(s, d).select("series_id", X.gain_advice(F.col("peak")).alias("a")).select("series_id", "a.kind", "a.delta_db"),
    "stage_alignment": lambda s, d: rounded(record.metric_rows(stages(s, d))),
    "metric_report_rows": lambda s, d: record.described(record.metric_rows(stages(s, d))),
    "band_edges": lambda s, d: rounded(tuning.band_edges(s)),
    "image_names": lambda s, d: record.image_names(measured(s, d).select(F.col("series_id").cast("string").alias("series_id"), F.col("has_bands").alias("has_room_tone"), "has_speech")),
    "run_record_json": lambda s, d: record.record_json(record.records(Detector(s, d).limits, {"noise": ["seed", "floor", "floored_share", "voice_activated"], "detector": ["split", "raw_split", "upper_mode", "margin"]})),
    "markdown_report": lambda s, d: record.markdown_table(record.described(record.metric_rows(stages(s, d)))),
}
