"""Quality of a recording and of a result, as composites of linear scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.exprs import is_finite, linear_score


def recording_score(peak: Column, integrated: Column, loudness_range: Column, floor: Column, speech: Column) -> Column:
    """Cleanliness, headroom and level of a capture, 0 to 100. Without a floor it counts as 0, without speech only the floor counts."""
    floor = F.coalesce(floor, F.lit(0.0))
    clean = linear_score(floor, -75, -45)
    clean = F.when(speech.isNull(), clean).otherwise(0.7 * linear_score(speech - floor, 45, 16) + 0.3 * clean)
    level = 0.6 * linear_score(F.greatest(F.lit(0.0), -23.0 - integrated), 6, 18) + 0.4 * linear_score(loudness_range, 13, 22)
    return 100.0 * (0.5 * clean + 0.3 * linear_score(peak, -6, -1) + 0.2 * level)


def quality_score(loudness: Column, target: Column, peaks: list[Column], floors: list[Column]) -> Column:
    """Loudness, true peak and noise of a result, 0 to 100. peaks and floors: where to look, in order; none is the worst case."""
    wanted = F.coalesce(F.nullif(target, F.lit(0.0)), F.lit(C.TARGET_LUFS))
    floor = F.coalesce(*floors)
    noise = F.when(floor == float("-inf"), 1.0).otherwise(F.coalesce(linear_score(floor, -75, -50), F.lit(0.0)))
    return 100.0 * (0.5 * linear_score(F.abs(loudness - wanted), 0.5, 3) + 0.3 * linear_score(F.coalesce(*peaks, F.lit(0.0)), C.TARGET_PEAK_DB, 0) + 0.2 * noise)


def measured_floor(level: Column) -> Column:
    """A room-tone level, null where it was not measured."""
    return F.when(is_finite(level) & (level != 0), level)


def gain_position(peak: Column) -> Column:
    """Place of a peak on a bar: -24, -12, -1 and 1 dB stand at 0, 0.33, 0.67 and 1, linear between and clamped."""
    part = lambda low, high, a, b: a + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (peak - low) / (high - low))) * (b - a)
    return F.when(peak < -12, part(-24.0, -12.0, 0.0, 0.33)).when(peak <= -1, part(-12.0, -1.0, 0.33, 0.67)).otherwise(part(-1.0, 1.0, 0.67, 1.0))


def real_time_factor(audio_s: Column, wall_s: Column) -> Column:
    return F.try_divide(audio_s, wall_s)
