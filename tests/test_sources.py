"""Sound, JSON and text sources, spectra, and the streaming form."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, spectral
from tidemark.plans import record
from tidemark.sources import readers, wav
from tidemark.streaming import rollup


def test_wav_to_intervals(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.synthetic_wav(2.0, rate=8000, tone_db=-20.0, noise_db=-90.0, gap=(1.0, 0.5)))
    (tmp_path / "broken.wav").write_bytes(b"no sound")
    frames = wav.read_frames(spark, str(tmp_path), frame=400).drop("rate_hz", "spectrum", "frame")
    got = {round(r.ts, 2): r for r in intervals.frame_intervals(frames).collect()}
    assert len(got) == 8
    assert got[0.25].rms_level == pytest.approx(-23.0, abs=0.2)
    assert got[1.25].rms_level == -120.0
    assert wav.metadata(spark, str(tmp_path)).count() == 2


def sound(width, channels, values, rate=1000):
    """A file of the values between -1 and 1, the same in each channel."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        for v in values:
            n = round(v * ((1 << (8 * width - 1)) - 1)) + (128 if width == 1 else 0)
            w.writeframes(n.to_bytes(width, "little", signed=width > 1) * channels)
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_widths_and_channels_give_the_same_levels(width, channels):
    values = [0.5, -0.25, 1.0, -1.0, 0.0] * 20
    rows = [r for df in wav.frames_of("a", sound(width, channels, values), 50) for r in df.itertuples()]
    assert [(r.frame, r.samples) for r in rows] == [(0, 50 * channels), (1, 50 * channels)]
    assert rows[0].peak == pytest.approx(1.0, abs=0.01)
    assert sum(r.sum_squares for r in rows) / channels == pytest.approx(sum(v * v for v in values), rel=0.02)


def test_ranges_equal_the_frames_of_the_whole(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.synthetic_wav(2.0, rate=8000))
    frames = lambda **k: {r.frame: tuple(r) for r in wav.read_frames(spark, str(tmp_path), 400, **k).collect()}
    whole = frames()
    assert sorted(whole) == list(range(40))
    for got, wanted in ((frames(start_s=1.01), range(20, 40)), (frames(start_s=1.0, end_s=1.2), range(20, 24)), (frames(start_s=1.0, end_s=1.1, pre_roll_s=0.5), range(10, 22)), (frames(start_s=0.2, end_s=0.3, pre_roll_s=5.0), range(6)), (frames(start_s=2.0), ()), (frames(start_s=0.5, end_s=0.5), ())):
        assert got == {k: whole[k] for k in wanted}


def test_headers_say_why_a_file_gives_no_frames(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(sound(3, 2, [0.1] * 500))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    (tmp_path / "c.wav").write_bytes(b"")
    (tmp_path / "d.wav").write_bytes(sound(2, 1, []))
    got = {r.series_id[-5]: r for r in wav.headers(spark, str(tmp_path)).collect()}
    assert tuple(got["a"])[1:] == (2, 1000, 24, 0.5, None)
    assert tuple(got["d"])[1:] == (1, 1000, 16, 0.0, None)
    assert got["b"].error.startswith("not a PCM WAV") and got["b"].rate_hz is None
    assert got.keys() == {"a", "b", "d"}
    assert {r.series_id[-5] for r in wav.read_frames(spark, str(tmp_path)).select("series_id").distinct().collect()} == {"a"}


def test_greedy_intervals_restart_at_the_closing_frame(spark):
    frames = spark.createDataFrame([("a", i * 0.1, 1.0, 10, 0.5) for i in range(10)], "series_id string, start_s double, sum_squares double, samples long, peak double")
    got = sorted((round(r.ts, 1), r.frames) for r in intervals.greedy_intervals(frames).collect())
    assert got == [(0.0, 4), (0.3, 3), (0.6, 3)]


def test_band_level_of_a_tone():
    x = np.sin(2 * np.pi * 1000 * np.arange(8000) / 16000)
    assert wav.band_level(x, 16000, 500, 2000) > wav.band_level(x, 16000, 3000, 6000) + 15
    assert wav.band_level(x, 16000, 3000, 9000) == float("-inf")


def test_spectral_edges(spark):
    rows = [("a", 0, [0.0, 0.0, 0.0, 0.0]), ("a", 1, [0.0, 1.0, 0.0, 0.0]), ("b", 2, [])]
    df = spark.createDataFrame(rows, "series_id string, i long, spectrum array<double>")
    got = {r.i: r for r in spectral.spectral_statistics(df, 8.0, "i").collect()}
    assert (got[0].centroid, got[0].crest, got[0].flux) == (1.0, 0.0, 0.0)
    assert (got[1].centroid, got[1].flux, got[1].rolloff) == (1.0, 1.0, 1.0)
    assert len(got) == 3


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, float("nan"), 2000.0), ("b", 1, -20.0, None)], "series_id string, timestamp long, rms_level double, spectral_centroid double")
    record.write_json_lines(df, str(tmp_path / "iv"))
    got = {r.series_id: r for r in readers.read_intervals(spark, str(tmp_path / "iv")).collect()}
    assert got["a"].rms_level is None and got["a"].found and got["a"].spectral.centroid == 2000.0
    assert not got["b"].found and got["b"].spectral is None
    record.write_json_lines(df, str(tmp_path / "c"), kind="speech")
    line = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*")).splitlines()[0]
    assert list(json.loads(line))[0] == "kind"


def test_stats_text(spark):
    df = spark.createDataFrame([('noise {"input_i": "-23.5", "mode": "linear", "bad": "x"} tail',), ("none",)], "t string").withColumn("m", readers.stats_from_text(F.col("t")))
    got = df.select(readers.number(F.col("m"), "input_i").alias("i"), readers.number(F.col("m"), "bad").alias("b")).collect()
    assert [tuple(r) for r in got] == [(-23.5, None), (None, None)]


def test_last_values(spark):
    df = spark.createDataFrame([("a", 0, {"x": "1"}), ("a", 1, {"x": "2", "y": "?"}), ("a", 2, {})], "series_id string, i long, metadata map<string,string>")
    assert tuple(readers.last_values(df, ["x", "y"], "i").first()) == ("a", 2.0, None)


def test_report_drops_empty_sections(spark):
    df = spark.createDataFrame([("a", 2, "Two", "b"), ("a", 1, "One", "a"), ("a", 3, "Three", "")], "series_id string, place int, heading string, body string")
    assert record.report(df).first().markdown == "## One\n\na\n\n## Two\n\nb"


def test_cells_are_escaped(spark):
    assert spark.range(1).select(record.escape_cell(F.lit("a|b\nc"))).first()[0] == r"a\|b c"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = rollup.event_intervals(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = {(r.series_id, int(r.ts.timestamp())): (r.n, r.rms_level) for r in spark.table("rolled").withColumn("ts", F.col("ts").cast("timestamp")).collect()}
    batch = intervals.event_intervals(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert {k: v[0] for k, v in got.items()} == {(r.series_id, r.ts): r.n for r in batch.collect()}
