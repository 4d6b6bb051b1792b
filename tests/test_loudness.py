"""Level statistics and loudness of known signals."""

import math

import numpy as np
import pytest

from tidemark.operators import level_stats, loudness
from tidemark.operators.chunks import chunked

RATE = 48_000


def signal(spark, x, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(x)], "series_id string, i long, x double")


def test_chunks_carry_what_came_before(spark):
    rows = chunked(signal(spark, range(10)), "i", 4, 2).collect()
    assert sorted((r.chunk, r.i, r.own) for r in rows) == sorted([(i // 4, i, True) for i in range(10)] + [(1, 2, False), (1, 3, False), (2, 6, False), (2, 7, False)])


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_statistics_by_hand(spark, chunk):
    x = [0.0, 0.5, 0.5, -0.25, 0.25, 0.5, -0.5, -0.5, -0.5, 0.125]
    got = level_stats.level_statistics(signal(spark, x), 5, chunk).first()
    d = np.abs(np.diff(x))
    db = lambda v: 20 * math.log10(v)
    rms = lambda v: math.sqrt(np.mean(np.square(v)))
    wanted = {"samples": 10, "dc_offset": np.mean(x), "min_level": -0.5, "max_level": 0.5, "min_difference": d.min(), "max_difference": d.max(), "mean_difference": d.mean(), "rms_difference": rms(d), "peak_db": db(0.5), "rms_db": db(rms(x)), "rms_trough_db": db(min(rms(x[:5]), rms(x[5:]))), "rms_peak_db": db(max(rms(x[:5]), rms(x[5:]))), "crest_db": db(0.5 / rms(x)), "dynamic_range_db": db(2 * 0.5 / 0.125), "noise_floor_db": db(0.5), "flat_factor_db": db((2**2 + 1 + 3**2) / 6), "zero_crossings": 4, "zero_crossing_rate": 0.4}
    assert got.asDict() == {"series_id": "a"} | {k: pytest.approx(v) for k, v in wanted.items()}


def test_silence_has_no_levels(spark):
    got = level_stats.level_statistics(signal(spark, [0.0] * 6), 3).first()
    assert got.rms_db == got.peak_db == float("-inf") and got.crest_db == 0 and got.dynamic_range_db is None
    found = loudness.programme_loudness(loudness.loudness_curve(spark.createDataFrame([("a", i, 0.0) for i in range(40)], "series_id string, block long, z double"))).first()
    assert (found.integrated, found.loudness_range) == (float("-inf"), 0.0)


def test_tone_has_the_recommended_loudness(spark):
    """A full-scale tone of 997 Hz reads -3.01 LUFS in one channel, whole and after quiet."""
    t = np.arange(12 * RATE) / RATE
    x = np.sin(2 * np.pi * 997 * t)
    x[: 2 * RATE] *= 1e-5
    blocks = loudness.energy_blocks(signal(spark, x), RATE)
    z = {r.block: r.z for r in blocks.collect()}
    assert sorted(z) == list(range(120))
    found = loudness.programme_loudness(loudness.loudness_curve(blocks, 37)).first()
    assert found.max_momentary == pytest.approx(-3.01, abs=0.02) and found.integrated == pytest.approx(-3.01, abs=0.15)
    assert found.max_short_term == pytest.approx(-3.01, abs=0.02)


def test_range_of_two_levels(spark):
    rows = [("a", i, 10 ** ((-20 if i < 200 else -35) / 10)) for i in range(400)]
    found = loudness.programme_loudness(loudness.loudness_curve(spark.createDataFrame(rows, "series_id string, block long, z double"), 64)).first()
    assert found.loudness_range == pytest.approx(15, abs=0.02)


def test_short_and_quiet_series_as_their_sql(spark):
    """No value where no window is full or no window passes the gate, as in the SQL of programme_loudness."""
    sizes = {"a": (3, 0.1), "b": (6, 0.1), "c": (40, 1e-9)}
    rows = [(name, i, z) for name, (n, z) in sizes.items() for i in range(n)]
    blocks = spark.createDataFrame(rows, "series_id string, block long, z double")
    got = {r.series_id: r for r in loudness.programme_loudness(loudness.loudness_curve(blocks, 40)).collect()}
    tone = pytest.approx(-10.691)
    assert tuple(got["a"])[1:] == (None,) * 6
    assert tuple(got["b"])[1:] == (tone, None, None, None, tone, None)
    assert tuple(got["c"])[1:] == (None, None, None, None, pytest.approx(-90.691), pytest.approx(-90.691))


def test_true_peak_lies_between_samples(spark):
    x = np.sin(2 * np.pi * np.arange(4800) / 4 + np.pi / 4)  # samples at 0.707 of the crest
    got = loudness.true_peak(signal(spark, x), RATE).first()
    assert got.sample_peak == pytest.approx(math.sqrt(0.5)) and got.true_peak == pytest.approx(1.0, abs=0.03)
