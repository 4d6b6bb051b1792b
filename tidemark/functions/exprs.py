"""Scalar column expressions: conversions, guards, scores and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as C


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or(x: Column, default) -> Column:
    return F.when(is_finite(x), x).otherwise(num(default))


def clamp(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.greatest(num(low), F.least(num(high), x)))


def db_to_linear(db) -> Column:
    return F.pow(F.lit(10.0), num(db) / 20.0)


def linear_to_db(x: Column) -> Column:
    """20 log10 x; the silence level for what has none."""
    return F.when(x > 0, 20.0 * F.log10(x)).otherwise(F.lit(C.SILENCE_DB))


def sample_to_db(x: Column) -> Column:
    """Level of a sample: absolute, 16-bit values scaled down, at most full scale."""
    a = F.abs(x)
    return linear_to_db(F.least(F.lit(1.0), F.when(a > 1, a / 32768.0).otherwise(a)))


def is_floored(x: Column) -> Column:
    return ~is_finite(x) | (x <= C.FLOORED_DB)


def passes_veto(centroid: Column, entropy: Column) -> Column:
    return centroid.between(*C.VETO_CENTROID_HZ) & (entropy < C.VETO_ENTROPY)


def hops(duration: Column, hop: Column) -> Column:
    """Durations as a count of hops, halves up; 0 without a hop."""
    return F.when(hop <= 0, F.lit(0)).otherwise(F.floor((duration + F.floor(hop / 2)) / hop)).cast("long")


def linear_score(x: Column, full, zero) -> Column:
    """1 at full, 0 at zero, linear between and clamped, in either direction."""
    full, zero = num(full), num(zero)
    return F.when(full == zero, (x == full).cast("double")).otherwise(clamp((x - zero) / F.nullif(full - zero, F.lit(0.0)), 0, 1))


def loudness_tier(loudness: Column) -> Column:
    return F.when(loudness > C.TIER_LUFS[0], "loud").when(loudness > C.TIER_LUFS[1], "mid").otherwise("quiet")


def by_tier(loudness: Column, values: tuple) -> Column:
    return F.when(loudness > C.TIER_LUFS[0], values[0]).when(loudness > C.TIER_LUFS[1], values[1]).otherwise(values[2])


def silence_threshold(floor: Column) -> Column:
    return clamp(floor + 6.0, -70, -35)


def clamp_split(split: Column, floor: Column, top: Column) -> Column:
    """Between the noise margin above the floor and the top percentile; the margin wins."""
    low = floor + C.NOISE_MARGIN_DB
    return F.when(top < low, low).otherwise(F.greatest(low, F.least(top, split)))


def nearest_rank(ordered: Column, percent: float) -> Column:
    """The element at the whole part of percent / 100 * (n - 1) of a sorted array; 0 if it is empty."""
    at = F.floor(F.lit(min(100.0, max(0.0, percent))) / 100.0 * (F.size(ordered) - 1)).cast("int")
    return F.when(F.size(ordered) > 0, F.get(ordered, at)).otherwise(F.lit(0.0))


def upper_median(ordered: Column) -> Column:
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def rolloff_score(x: Column) -> Column:
    low, best, most, high = C.ROLLOFF_HZ
    return F.when(x.between(best, most), 1.0).when((x >= low) & (x < best), 0.5 + 0.5 * (x - low) / (best - low)).when((x > most) & (x <= high), 0.5 + 0.5 * (high - x) / (high - most)).otherwise(0.0)


def flux_score(x: Column) -> Column:
    (x0, y0), *rest = C.FLUX_STEPS
    out = F.when(x <= x0, y0)
    for x1, y1 in rest:
        out = out.when(x <= x1, y0 - (x - x0) / (x1 - x0) * round(y0 - y1, 10))
        x0, y0 = x1, y1
    return out.otherwise(y0)


def voicing_score(density: Column) -> Column:
    return clamp(density / C.VOICING_FULL, 0, 1)


def snr_score(snr: Column) -> Column:
    half, full = C.CANDIDATE_SNR_DB
    return F.when(snr <= 0, 0.0).when(snr >= full, 1.0).when(snr < half, 0.5 * snr / half).otherwise(0.5 + 0.5 * (snr - half) / (full - half))


def candidate_score(level: Column, floor: Column, seconds: Column, variance: Column) -> Column:
    """Margin over the noise floor, length and steadiness. Without a floor the margin counts as full."""
    snr, length, steady = C.CANDIDATE_WEIGHTS
    return snr * F.coalesce(snr_score(level - floor), F.lit(1.0)) + length * F.least(seconds / C.CANDIDATE_FULL_S, F.lit(1.0)) + steady * clamp(1.0 - variance / C.CANDIDATE_VARIANCE_CAP, 0, 1)


def window_score(m: dict[str, Column]) -> Column:
    """Score of a window from its means (kurtosis, flatness, centroid, rms, rolloff, flux), kurtosis variance and voicing density."""
    low, high = C.VETO_CENTROID_HZ
    mid, half = (low + high) / 2, (high - low) / 2
    terms = {
        "kurtosis": clamp(m["kurtosis"] / 7.5, 0, 1),
        "flatness": clamp(1.0 - m["flatness"], 0, 1),
        "centroid": F.when(m["centroid"].between(low, high), 1.0 - F.abs(m["centroid"] - mid) / half * 0.5).otherwise(0.0),
        "consistency": clamp(1.0 - m["kurtosis_variance"] / 100.0, 0, 1),
        "rms": F.when(m["rms"] > -30, clamp((m["rms"] + 30.0) / 18.0, 0, 1)).otherwise(0.0),
        "voicing": voicing_score(m["voicing"]),
        "rolloff": rolloff_score(m["rolloff"]),
        "flux": flux_score(m["flux"]),
    }
    total = F.lit(0.0)
    for name, weight in C.WINDOW_WEIGHTS.items():
        total = total + weight * terms[name]
    return total


def stars(score: Column) -> Column:
    out = F.when(score >= C.STARS[0][0], C.STARS[0][1])
    for least, n, _ in C.STARS[1:-1]:
        out = out.when(score >= least, n)
    return out.otherwise(C.STARS[-1][1])


def star_label(score: Column) -> Column:
    out = F.when(score >= C.STARS[0][0], C.STARS[0][2])
    for least, _, label in C.STARS[1:-1]:
        out = out.when(score >= least, label)
    return out.otherwise(C.STARS[-1][2])


def gain_advice(peak: Column) -> Column:
    """struct(kind, delta_db): how far the input gain is from a peak of -6 dB."""
    kind = F.when(peak >= 0, "clipping").when(peak > -1, "hot").when(peak < -12, "quiet").otherwise("fine")
    return F.struct(kind.alias("kind"), F.when((peak > -1) | (peak < -12), F.round(-6.0 - peak)).otherwise(0.0).alias("delta_db"))


def gain_message(peak: Column) -> Column:
    advice = gain_advice(peak)
    lower = F.format_string("Peaks at %+.1f ㏈TP. Lower input gain ~%.0f ㏈.", peak, F.abs(advice["delta_db"]))
    return (
        F.when(peak >= 0, F.concat(F.lit("Clipping. "), lower))
        .when(peak > -1, F.concat(F.lit("Hot. "), lower))
        .when(peak < -12, F.format_string("Quiet. Peaks at %+.1f ㏈TP. Raise input gain ~%.0f ㏈.", peak, F.abs(advice["delta_db"])))
        .otherwise(F.format_string("Level well set. Peaks at %+.1f ㏈TP. No action required.", peak))
    )


def fixed(x: Column, decimals: int = 2) -> Column:
    return F.when(is_finite(x), F.format_string(f"%.{decimals}f", x)).otherwise("-")


def metric(x: Column, decimals: int = 2) -> Column:
    """Fixed decimals, scientific for what is tiny."""
    return F.when(is_finite(x) & (F.abs(x) > 0) & (F.abs(x) < 1e-4), F.format_string("%.2e", x)).otherwise(fixed(x, decimals))


def metric_db(x: Column, decimals: int = 1) -> Column:
    return F.when((x == float("-inf")) | (x <= C.SILENCE_DB), "< -120").otherwise(fixed(x, decimals))


def metric_lufs(x: Column, decimals: int = 1) -> Column:
    return F.when(x < -70, "< -70").otherwise(fixed(x, decimals))


def metric_signed(x: Column, decimals: int = 1) -> Column:
    return F.when(is_finite(x), F.format_string(f"%+.{decimals}f", x)).otherwise("-")


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    h, m, s = (F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60)
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%dh %dm %ds", h, m, s))


def channel_name(n: Column) -> Column:
    return F.when(n == 1, "mono").when(n == 2, "stereo").otherwise(F.format_string("%d channels", n))


def escape_option(x: Column) -> Column:
    r"""Backslash before \ ' : , [ ]."""
    return F.regexp_replace(x, r"([\\':,\[\]])", r"\\$1")
