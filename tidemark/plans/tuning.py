"""Parameters derived from a series' measurements, and the chain they describe. One row a series, expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.exprs import clamp, db_to_linear, finite_or, is_finite

GATE_DB = (-80.0, -25.0)
GATE_MARGIN_DB = 6.0
GATE_DEPTH_DB, GATE_DEPTH_NARROW_DB = 14.0, 8.0


def band_shape(bands: Column) -> Column:
    """Band levels around their mean over the finite ones, within 24 dB, one decimal, joined by |; empty if none is finite."""
    known = F.filter(bands, is_finite)
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))
    shape = F.transform(bands, lambda v: F.format_string("%.1f", F.when(is_finite(v), clamp(v - mean, -24, 24)).otherwise(0.0)))
    return F.when(F.size(known) > 0, F.array_join(shape, "|")).otherwise("")


def band_edges(spark) -> DataFrame:
    """(band, centre_hz, low_hz, high_hz): geometric means between neighbours, mirrored at both ends."""
    centres = spark.createDataFrame([(i, float(c)) for i, c in enumerate(C.BAND_CENTRES_HZ)], "band int, centre_hz double")
    w = Window.orderBy("band")  # a fixed table of few rows
    centre, before, after = F.col("centre_hz"), F.lag("centre_hz").over(w), F.lead("centre_hz").over(w)
    return centres.select("band", "centre_hz", F.coalesce(F.sqrt(before * centre), centre / F.sqrt(after / centre)).alias("low_hz"), F.coalesce(F.sqrt(centre * after), centre * F.sqrt(centre / before)).alias("high_hz"))


def tune_denoise(df: DataFrame) -> DataFrame:
    """From voice_activated, floor, separation, room_flatness, band_levels: denoise_on, denoise_floor, track_noise, noise_type, band_shape."""
    on = ~F.coalesce(F.col("voice_activated"), F.lit(False))
    known = F.coalesce(is_finite(F.col("floor")) & (F.col("floor") != 0), F.lit(False))
    measured = F.coalesce(F.size(F.filter("band_levels", is_finite)) >= C.BANDS_LEAST_FINITE, F.lit(False))
    custom = F.coalesce(on & known & measured & (F.col("separation") >= 12) & (F.col("room_flatness") >= 0.45), F.lit(False))
    df = df.withColumn("denoise_on", on).withColumn("denoise_floor", F.when(on & known, clamp(F.col("floor"), -80, -20)).otherwise(0.0)).withColumn("track_noise", ~(on & known))
    return df.withColumn("noise_type", F.when(custom, "custom").otherwise("w")).withColumn("band_shape", F.when(custom, band_shape(F.col("band_levels"))).otherwise(""))


def tune_gate(df: DataFrame) -> DataFrame:
    """From has_speech, voiced_low, separation, range_lu, integrated, floor, room_crest, room_peak: threshold, ratio, depth and why."""
    narrow = F.col("has_speech") & (F.col("separation") < 2 * GATE_MARGIN_DB)
    ratio = F.when(F.col("range_lu") > 15, 1.5).otherwise(2.0)
    gap = F.greatest(F.lit(0.0), C.TARGET_LUFS - F.col("integrated"))
    by_peak = (F.col("room_crest") > 20) & (F.col("room_peak") != 0) & (gap < 25)
    fallback = F.when(by_peak, F.col("room_peak") + 3.0).otherwise(F.greatest(F.lit(-40.0), F.col("floor") + 12.0 / (1.0 - 1.0 / ratio)))
    free = F.when(F.col("has_speech"), F.col("voiced_low") - GATE_MARGIN_DB).otherwise(fallback)
    df = df.withColumn("gate_unclamped_db", F.when(F.col("has_speech"), free).otherwise(0.0)).withColumn("gate_threshold_db", clamp(free, *GATE_DB)).withColumn("gate_ratio", ratio).withColumn("gate_narrow", F.coalesce(narrow, F.lit(False)))
    df = df.withColumn("gate_depth_db", F.when(F.col("gate_narrow"), GATE_DEPTH_NARROW_DB).otherwise(GATE_DEPTH_DB)).withColumn("gate_reason", F.when(~F.col("has_speech"), "").when(F.col("gate_narrow"), "narrow_gap").otherwise("none"))
    return df.withColumn("gate_headroom_db", F.when(F.col("has_speech"), F.col("voiced_low") - F.col("gate_threshold_db")).otherwise(0.0))


def tune_deesser(df: DataFrame) -> DataFrame:
    """From has_bands, sibilant_db, body_db: deess_intensity, linear between 0 at -6, 0.6 at -3 and 0.85 at 0 dB of excess."""
    x = F.col("sibilant_db") - F.col("body_db")
    ramp = F.when(x < -6, 0.0).when(x < -3, (x + 6.0) / 3.0 * 0.6).when(x < 0, 0.6 + (x + 3.0) / 3.0 * 0.25).otherwise(0.85)
    return df.withColumn("deess_intensity", F.when(F.col("has_bands"), ramp).otherwise(0.0))


def tune_compressor(df: DataFrame) -> DataFrame:
    """From has_speech, speech_rms, file_rms, peak_level: compressor_threshold_db."""
    level = F.when((F.col("file_rms") < 0) & is_finite(F.col("file_rms")), F.greatest("speech_rms", "file_rms")).otherwise(F.col("speech_rms"))
    found = F.when(F.col("has_speech"), clamp(level + 9.0, -45, -6)).when(is_finite(F.col("peak_level")), clamp(F.col("peak_level") - 20.0, -45, -6)).otherwise(-18.0)
    return df.withColumn("compressor_threshold_db", found)


def sanitise(df: DataFrame) -> DataFrame:
    """Replaces derived values that are not finite by defaults."""
    for name, default in (("gate_threshold_db", -40.0), ("gate_ratio", 2.0), ("gate_depth_db", GATE_DEPTH_DB), ("deess_intensity", 0.0), ("compressor_threshold_db", -18.0), ("denoise_floor", 0.0)):
        df = df.withColumn(name, F.coalesce(finite_or(F.col(name), default), F.lit(default)))
    return df


def tune(df: DataFrame) -> DataFrame:
    """All of the above."""
    return sanitise(tune_compressor(tune_deesser(tune_gate(tune_denoise(df)))))


def biquad(keyword: str, frequency: float) -> Column:
    return F.lit(f"{keyword}=f={frequency:.0f}:poles=2:width_type=q:width=0.707:normalize=1:a=tdii")


def denoise_text() -> Column:
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    shape = F.when((F.col("noise_type") == "custom") & (F.col("band_shape") != ""), F.concat(F.lit("custom:bn="), "band_shape")).otherwise(F.col("noise_type"))
    tail = F.when(F.col("denoise_floor") < 0, F.concat(F.lit(":nf="), number(F.col("denoise_floor")))).otherwise("")
    spectral = F.when(F.col("denoise_on"), F.concat(F.lit(",afftdn=nr=12:nt="), shape, F.lit(":tn="), F.col("track_noise").cast("int"), tail)).otherwise("")
    return F.concat(F.lit("anlmdn=s=0.00001:p=0.0060:r=0.0020:m=3"), spectral)


#: Builders of the chain's steps by name; an empty text drops the step.
STEPS: dict[str, Callable[[], Column]] = {
    "downmix": lambda: F.lit("aformat=channel_layouts=mono"),
    "rumble": lambda: biquad("highpass", 80),
    "band_limit": lambda: biquad("lowpass", 20500),
    "denoise": denoise_text,
    "gate": lambda: F.format_string("agate=threshold=%.6f:ratio=%.1f:attack=5.00:release=200:range=%.4f:knee=3.0:detection=rms:makeup=1.0", db_to_linear(F.col("gate_threshold_db")), F.col("gate_ratio"), db_to_linear(-F.col("gate_depth_db"))),
    "compressor": lambda: F.format_string("acompressor=threshold=%.6f:ratio=3.0:attack=10:release=200:makeup=1.00:knee=4.0:detection=rms:mix=1.00", db_to_linear(F.col("compressor_threshold_db"))),
    "deesser": lambda: F.when(F.col("deess_intensity") > 0, F.format_string("deesser=i=%.2f:m=0.50:f=0.80", F.col("deess_intensity"))).otherwise(""),
    "analysis": lambda: F.lit("astats=metadata=1:measure_perchannel=all,aspectralstats=win_size=2048:win_func=hann:measure=all,ebur128=metadata=1:peak=sample+true:dualmono=true:target=-16"),
    "resample": lambda: F.lit("aformat=sample_rates=44100:channel_layouts=mono:sample_fmts=s16,asetnsamples=n=4096"),
}
ORDER = tuple(STEPS)


def chain_text(order: tuple[str, ...] = ORDER) -> Column:
    """The chain as text, steps in order, empty ones dropped."""
    return F.array_join(F.filter(F.array(*(STEPS[name]() for name in order)), lambda s: s != ""), ",")


def limiter_plan(df: DataFrame) -> DataFrame:
    """From out_integrated and out_peak: whether limiting is needed, its ceiling, the gain before it and the text of both."""
    gain = C.TARGET_LUFS - F.col("out_integrated")
    free = C.TARGET_PEAK_DB - gain
    needed = F.col("out_peak") + gain > C.TARGET_PEAK_DB
    clamped = needed & (free < C.LIMITER_MIN_DB)
    pre = F.when(free < C.LIMITER_MIN_DB, C.LIMITER_MIN_DB - free).otherwise(0.0)
    ceiling = F.when(clamped, C.TARGET_PEAK_DB - (C.TARGET_LUFS - (F.col("out_integrated") + pre))).when(needed, free).otherwise(0.0)
    df = df.withColumn("gain_db", gain).withColumn("limit", needed).withColumn("limit_clamped", clamped).withColumn("pre_gain_db", pre).withColumn("ceiling_db", ceiling)
    volume = F.when(F.col("pre_gain_db") > 0, F.format_string("volume=%.1fdB,", F.col("pre_gain_db"))).otherwise("")
    return df.withColumn("limiter_text", F.when(F.col("limit"), F.concat(volume, limiter_text(F.col("ceiling_db"), 5, 100))).otherwise(""))


def limiter_text(ceiling_db: Column, attack: int, release: int) -> Column:
    return F.format_string(f"alimiter=limit=%.6f:attack={attack}:release={release}:level_in=1:level_out=1:level=0:latency=1:asc=1:asc_level=0.8", db_to_linear(ceiling_db))


def linear_target(df: DataFrame) -> DataFrame:
    """From measured_integrated and measured_peak: the loudness that a constant gain reaches, peak targets and the brickwall."""
    inner = F.col("measured_peak") + (C.TARGET_LUFS - F.col("measured_integrated")) + (C.LINEAR_SAFETY_DB + C.PEAK_CUSHION_DB)
    df = df.withColumn("inner_peak_db", inner)
    most = F.col("inner_peak_db") - F.col("measured_peak") + F.col("measured_integrated") - C.LINEAR_SAFETY_DB
    df = df.withColumn("linear", C.TARGET_LUFS <= most).withColumn("target_lufs", F.least(F.lit(C.TARGET_LUFS), most))
    df = df.withColumn("offset_db", F.col("target_lufs") - F.col("measured_integrated")).withColumn("emitted_peak_db", clamp(F.col("inner_peak_db"), *C.PEAK_OPTION_DB))
    return df.withColumn("brickwall_db", F.lit(C.TARGET_PEAK_DB - C.BRICKWALL_HEADROOM_DB)).withColumn("brickwall_text", limiter_text(F.col("brickwall_db"), 1, 50))


def normalisation(df: DataFrame) -> DataFrame:
    """From final_integrated, target_lufs and mode: status, deviation, whether it hit the target and whether gain varied."""
    silent = F.col("measured_integrated") < -70
    df = df.withColumn("status", F.when(silent, "silent").otherwise("ok")).withColumn("deviation_lu", F.col("final_integrated") - F.col("target_lufs"))
    return df.withColumn("within_target", ~silent & (F.abs("deviation_lu") <= C.TARGET_TOLERANCE_LU)).withColumn("varied", F.lower(F.trim("mode")) == "dynamic")
