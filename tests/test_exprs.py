"""Scalar layer: anchors and traps."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.plans import scores, tuning
from tidemark.plans.record import analysis_name, without_nan


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("x,db", [(1.0, 0.0), (0.0, -120.0), (-1.0, -120.0), (0.1, -20.0)])
def test_linear_to_db(spark, x, db):
    assert value(spark, X.linear_to_db(F.lit(x))) == pytest.approx(db)


@pytest.mark.parametrize("x,db", [(0.5, -6.0206), (-0.5, -6.0206), (16384.0, -6.0206), (0.0, -120.0), (65536.0, 0.0)])
def test_sample_to_db(spark, x, db):
    assert value(spark, X.sample_to_db(F.lit(x))) == pytest.approx(db, abs=1e-4)


@pytest.mark.parametrize("x,floored", [(float("nan"), True), (float("inf"), True), (float("-inf"), True), (-115.0, True), (-114.9, False)])
def test_floored(spark, x, floored):
    assert value(spark, X.is_floored(F.lit(x))) is floored


@pytest.mark.parametrize("d,h,n", [(10_000, 250, 40), (2_000, 250, 8), (2_000, 100, 20), (5, 0, 0)])
def test_hops(spark, d, h, n):
    assert value(spark, X.hops(F.lit(d), F.lit(h))) == n


@pytest.mark.parametrize("p,at", [(0, 0), (10, 1), (25, 2), (50, 5), (75, 7), (100, 10), (200, 10), (-5, 0)])
def test_nearest_rank_takes_the_lower_rank(spark, p, at):
    assert value(spark, X.nearest_rank(F.array(*(F.lit(float(i)) for i in range(11))), p)) == at
    assert value(spark, X.nearest_rank(F.array().cast("array<double>"), p)) == 0


def test_split_margin_wins_over_percentile(spark):
    assert value(spark, X.clamp_split(F.lit(-10.0), F.lit(-20.0), F.lit(-30.0))) == -18.0
    assert value(spark, X.clamp_split(F.lit(-10.0), F.lit(-60.0), F.lit(-30.0))) == -30.0


def test_scores_of_null_are_null(spark):
    assert value(spark, X.linear_score(F.lit(None).cast("double"), -6, -1)) is None
    assert value(spark, X.clamp(F.lit(None).cast("double"), 0, 1)) is None


@pytest.mark.parametrize("x,score", [(0.004, 1.0), (0.007, 0.85), (0.010, 0.7), (0.020, 0.4), (0.030, 0.2), (1.0, 0.2)])
def test_flux_score(spark, x, score):
    assert value(spark, X.flux_score(F.lit(x))) == pytest.approx(score)


@pytest.mark.parametrize("peak,integrated,lra,floor,speech,stars,label", [(-0.1, -29.8, 12.3, -72.93, -34.79, 2, "Fair"), (-6.2, -35.2, 15.0, -78.05, -38.74, 4, "Great"), (-4.5, -27.8, 14.7, -70.47, -30.92, 4, "Great"), (-9.0, -21.0, 9.0, -80.0, -28.0, 5, "Excellent")])
def test_recording_anchors(spark, peak, integrated, lra, floor, speech, stars, label):
    score = scores.recording_score(*(F.lit(v) for v in (peak, integrated, lra, floor, speech)))
    assert value(spark, X.stars(score)) == stars
    assert value(spark, X.star_label(score)) == label


def test_recording_without_floor_or_speech(spark):
    none = F.lit(None).cast("double")
    assert value(spark, scores.recording_score(F.lit(0.0), F.lit(-60.0), F.lit(30.0), none, none)) == 0


@pytest.mark.parametrize("peak,kind,delta", [(0.5, "clipping", -7.0), (-0.5, "hot", -6.0), (-6.0, "fine", 0.0), (-1.0, "fine", 0.0), (-12.0, "fine", 0.0), (-20.0, "quiet", 14.0)])
def test_gain_advice(spark, peak, kind, delta):
    got = value(spark, X.gain_advice(F.lit(peak)))
    assert (got.kind, got.delta_db) == (kind, delta)


@pytest.mark.parametrize("x,text", [(1.5, "1.5s"), (125.0, "2m 5s"), (3723.0, "1h 2m 3s")])
def test_duration_text(spark, x, text):
    assert value(spark, X.duration_text(F.lit(x))) == text


def test_formats(spark):
    assert value(spark, X.fixed(F.lit(float("nan")))) == "-"
    assert value(spark, X.metric(F.lit(0.00005), 4)) == "5.00e-05"
    assert value(spark, X.metric_lufs(F.lit(-71.0))) == "< -70"
    assert value(spark, X.escape_option(F.lit("a:b,c'd[e]\\"))) == r"a\:b\,c\'d\[e\]" + "\\\\"
    assert value(spark, analysis_name(F.lit("a.b.flac"))) == "a.b-flac-analysis.md"


def test_band_shape(spark):
    bands = F.array(*(F.lit(v) for v in (-60.0, -50.0, float("nan"), -100.0)))
    assert value(spark, tuning.band_shape(bands)) == "10.0|20.0|0.0|-24.0"
    assert value(spark, tuning.band_shape(F.array(F.lit(float("nan"))))) == ""


@pytest.mark.parametrize("integrated,peak,needed,clamped,ceiling,pre", [(-30.0, -10.0, True, False, -15.0, 0.0), (-20.0, -10.0, False, False, 0.0, 0.0), (-45.0, -5.0, True, True, -24.0, 6.0)])
def test_limiter_plan(spark, integrated, peak, needed, clamped, ceiling, pre):
    got = tuning.limiter_plan(spark.createDataFrame([(integrated, peak)], "out_integrated double, out_peak double")).first()
    assert (got.limit, got.limit_clamped, got.ceiling_db, got.pre_gain_db) == (needed, clamped, ceiling, pre)


def test_without_nan_reaches_every_depth(spark):
    df = spark.sql("SELECT named_struct('a', double('NaN'), 'b', array(1D, double('Infinity')), 'c', map('k', double('-Infinity'))) AS s")
    got = df.select(without_nan(F.col("s"), df.schema["s"].dataType).alias("s")).first().s
    assert (got.a, got.b, got.c) == (None, [1.0, None], {"k": None})
    assert not math.isnan(got.b[0])


def test_names_and_messages(spark):
    from tidemark.plans import record

    name = lambda p, x: value(spark, record.output_name(F.lit(p), F.lit(x)))
    assert name("/a/b.c/show.wav", -16.4) == "/a/b.c/show-LUFS-16-processed.flac"
    assert name("talk", -15.6) == "talk-LUFS-16-processed.flac"
    assert value(spark, X.gain_message(F.lit(0.5))) == "Clipping. Peaks at +0.5 ㏈TP. Lower input gain ~7 ㏈."
    assert [value(spark, X.metric_lufs(F.lit(x))) for x in (-120.0, float("-inf"), -70.0)] == ["< -70", "< -70", "-70.0"]
    row = spark.createDataFrame([("ep1", True, False)], "series_id string, has_room_tone boolean, has_speech boolean")
    assert {r.name for r in record.image_names(row, ("input",)).collect()} == {"ep1.spectrogram-whole-input.png", "ep1.spectrogram-roomtone-input.png"}
