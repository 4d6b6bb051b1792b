"""Segmentation against a plain state machine, with the cases that are easy to get wrong."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import levels, segments

SPLIT, MARGIN, TOL = -30.0, 3.0, 8


def plain_runs(rows, split, margin, tol, hop, least):
    """rows: (level, veto passes); the transition table as loops."""
    out, on, start, n, last, gap = [], False, 0, 0, 0, 0

    def flush():
        if n >= least:
            out.append((start * hop, (last + 1) * hop, n))

    for i, (x, ok) in enumerate(rows):
        if not on:
            if x >= split + margin and ok:
                on, start, n, last, gap = True, i, 1, i, 0
        elif x >= split and ok:
            n, last, gap = n + 1, i, 0
        elif x >= split:
            flush()
            on = False
        elif x < split - margin:
            gap += 1
            if gap > tol:
                flush()
                on = False
    if on:
        flush()
    return out


def spark_runs(spark, series, tol, least, hop=1):
    rows = [(s, i * hop, float(x), SPLIT, MARGIN, bool(ok)) for s, items in series.items() for i, (x, ok) in enumerate(items)]
    flags = spark.createDataFrame(rows, "series_id string, ts long, momentary double, split double, margin double, veto_ok boolean")
    tolerance = spark.createDataFrame([(s, tol) for s in series], "series_id string, tolerance long")
    got = segments.speech_runs(flags, tolerance, hop, least).collect()
    return {s: sorted((r.start, r.end, r.intervals) for r in got if r.series_id == s) for s in series}


SPEECH, QUIET, LOUD = (-15.0, True), (-60.0, True), (-15.0, False)
CASES = {
    "bridged": ([SPEECH] * 50 + [QUIET] * 7 + [SPEECH] * 50, 1),
    "parted": ([SPEECH] * 50 + [QUIET] * 13 + [SPEECH] * 50, 2),
    "neutral": ([SPEECH] * 50 + [(-31.0, True)] * 3 + [SPEECH] * 50, 1),
    "neutral holds the gap": ([SPEECH] * 50 + [QUIET] * 8 + [(-31.0, True)] * 20 + [QUIET] + [SPEECH] * 50, 2),
    "veto": ([SPEECH] * 50 + [LOUD] + [SPEECH] * 50, 2),
    "short": ([SPEECH] * 39 + [QUIET] * 50, 0),
    "nan is held": ([SPEECH] * 50 + [(math.nan, True)] * 30 + [SPEECH] * 50, 1),
    "never": ([QUIET] * 50, 0),
}


def test_cases(spark):
    got = spark_runs(spark, {k: v for k, (v, _) in CASES.items()}, TOL, 40)
    assert {k: len(v) for k, v in got.items()} == {k: n for k, (_, n) in CASES.items()}
    assert got == {k: plain_runs(v, SPLIT, MARGIN, TOL, 1, 40) for k, (v, _) in CASES.items()}


level = st.tuples(st.sampled_from([-15.0, -26.9, -27.0, -30.0, -30.1, -33.0, -33.1, -60.0]), st.booleans())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(level, max_size=60), min_size=5, max_size=5), st.integers(0, 4), st.integers(1, 6))
def test_any_series(spark, series, tol, least):
    named = {str(i): s for i, s in enumerate(series) if s} or {"x": [QUIET]}
    assert spark_runs(spark, named, tol, least) == {k: plain_runs(v, SPLIT, MARGIN, tol, 1, least) for k, v in named.items()}


def test_gap_tolerance_ignores_edges(spark):
    flags = [False] * 20
    for gap in (4, 6, 12, 30):
        flags += [True] + [False] * gap
    flags += [True] + [False] * 20
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)] + [("none", 0, False)], "series_id string, ts long, speech boolean")
    assert {r.series_id: r.tolerance for r in segments.gap_tolerance(df, (8, 40)).collect()} == {"a": 12, "none": 8}


def table(spark, values, flux=0.1):
    return spark.createDataFrame([("a", i, float(v), flux) for i, v in enumerate(values)], "series_id string, ts long, momentary double, flux double")


def test_histogram_and_split(spark):
    values = [-50 + i % 3 for i in range(30)] + [-20 + i % 3 for i in range(30)] + [-130]
    bins = levels.histogram(table(spark, values), width=2.0)
    assert bins.agg(F.sum("n")).first()[0] == 60
    split = levels.otsu(bins, 2.0).first().split
    assert -48 <= split <= -20


def test_split_of_one_class_is_the_middle(spark):
    assert levels.otsu(levels.histogram(table(spark, [-40.0] * 5))).first().split == -40.0


def test_seed_needs_intervals_and_skips_silence(spark):
    assert levels.noise_seed(table(spark, [-50.0] * 9)).first().seed == -115.0
    got = levels.noise_seed(table(spark, [-120.0] * 30 + [-60.0] * 4 + [-20.0] * 16)).first()
    assert got.seed in (-115.0, -60.0)
    assert levels.noise_seed(table(spark, [-120.0] * 30)).first().threshold is None


def test_order_of_rows_does_not_matter(spark):
    values = [-60.0, -55.0, -50.0, -20.0, -21.0, -22.0] * 5
    one = levels.noise_seed(table(spark, values)).first()
    other = levels.noise_seed(table(spark, values).orderBy(F.desc("ts"))).first()
    assert one == other


def test_summary(spark):
    values = [-70.0, -68.0, -66.0, -64.0, -62.0, -60.0, -38.0, -36.0, -34.0, -32.0, -30.0, -130.0]
    df = table(spark, values).withColumnRenamed("momentary", "rms_level")
    got = levels.interval_summary(df).first()
    assert (got.intervals, got.p10, got.p25, got.p50, got.p75, got.p90, got.widest_gap, got.gap_low) == (12, -68.0, -66.0, -60.0, -34.0, -32.0, 22.0, -60.0)


def test_refine_keeps_the_first_of_equals_and_short_regions(spark):
    rows = [("a", i, -50.0 if 3 <= i % 10 < 6 else -20.0) for i in range(30)]
    iv = spark.createDataFrame(rows, "series_id string, ts long, rms_level double")
    regions = spark.createDataFrame([("a", 0, 30), ("a", 100, 102)], "series_id string, start long, end long")
    got = {r.original_start: r for r in segments.refine(iv, regions, 1, 3, 2, lambda w: F.avg("rms_level").over(w), lowest=True).collect()}
    assert (got[0].start, got[0].end, got[0].refined) == (3, 6, True)
    assert (got[100].start, got[100].end, got[100].refined) == (100, 102, False)


@pytest.mark.parametrize("start,end,n", [(0, 10, 10), (5, 5, 0), (9, 12, 3), (28, 99, 2)])
def test_half_open_regions(spark, start, end, n):
    from tidemark.operators.intervals import in_regions

    iv = spark.createDataFrame([("a", i) for i in range(30)], "series_id string, ts long")
    regions = spark.createDataFrame([("a", start, end)], "series_id string, start long, end long")
    assert in_regions(iv, regions, bin_s=4).count() == n
