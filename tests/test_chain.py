"""The whole chain's text against a plain version, for every customer and every kind of denoiser."""

import math

from tidemark import catalogue
from tidemark.plans import tuning

SF = "/root/testdata/sf0.001"
NAN = float("nan")


def plain_denoise(r):
    """The denoiser's text of one customer, from its measurements."""
    text = "anlmdn=s=0.00001:p=0.0060:r=0.0020:m=3"
    if r.voice_activated:
        return text
    shape, floor = "w", max(-80.0, min(-20.0, r.floor))
    known = [v for v in r.band_levels if math.isfinite(v)]
    if len(known) >= 10 and r.separation >= 12 and r.room_flatness >= 0.45:
        mean = sum(known) / len(known)
        shape = "custom:bn=" + "|".join(f"{max(-24.0, min(24.0, v - mean)):.1f}" if math.isfinite(v) else "0.0" for v in r.band_levels)
    return f"{text},afftdn=nr=12:nt={shape}:tn=0:nf={repr(floor).removesuffix('.0')}"


def test_chain_holds_every_step_for_every_customer(spark):
    rows = {r.series_id: r for r in catalogue.measured(spark, SF).collect()}
    got = {r.series_id: r.spec for r in catalogue.QUERIES["filter_chain"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    assert sum("custom:bn=" in x for x in got.values()) > 0
    for i, r in rows.items():
        before, after = got[i].split(",agate=")
        assert before.split(",anlmdn=")[0].count(",") == 2
        assert "anlmdn=" + before.split(",anlmdn=")[1] == plain_denoise(r)
        assert "acompressor=" in after and ",astats=" in after and "ebur128=" in after and after.endswith("asetnsamples=n=4096")


def test_denoise_of_a_custom_shape(spark):
    bands = [-60.0, -50.0, NAN, *[-40.0] * 9, 10.0, -40.5, -41.0]
    df = spark.createDataFrame([(False, -61.25, 12.0, 0.45, bands), (True, -61.25, 12.0, 0.45, bands), (False, 0.0, 12.0, 0.45, bands)], "voice_activated boolean, floor double, separation double, room_flatness double, band_levels array<double>")
    got = [r.t for r in tuning.tune_denoise(df).select(tuning.denoise_text().alias("t")).collect()]
    plain = "anlmdn=s=0.00001:p=0.0060:r=0.0020:m=3"
    assert got == [f"{plain},afftdn=nr=12:nt=custom:bn=-21.3|-11.3|0.0|{'|'.join(['-1.3'] * 9)}|24.0|-1.8|-2.3:tn=0:nf=-61.25", plain, f"{plain},afftdn=nr=12:nt=w:tn=1"]
