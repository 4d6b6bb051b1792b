"""Sound files as frames: WAV decoding with the standard library, a synthetic signal, spectra, band levels."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = 4096
WINDOW = 2048


def sounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)


def read_frames(spark: SparkSession, path: str, frame: int = FRAME, start_s: float = 0.0, end_s: float | None = None, pre_roll_s: float = 0.0) -> DataFrame:
    """(series_id, frame, start_s, sum_squares, samples, peak, rate_hz, spectrum) of every WAV file below path.

    All channels count for levels; the spectrum is that of the mono mix, Hann window, WINDOW points. A range begins with the
    frame that holds start_s less the pre-roll and ends before end_s; frames keep their numbers and times in the file, so a
    caller drops the pre-roll by start_s. A range beyond the end gives no rows. One task decodes a file, 2 GB at most. A file
    that is no PCM WAV gives no rows here and its reason in headers().
    """
    schema = "series_id string, frame long, start_s double, sum_squares double, samples long, peak double, rate_hz long, spectrum array<double>"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield from frames_of(name, content, frame, max(0.0, start_s - pre_roll_s), end_s)

    return sounds(spark, path).select("path", "content").mapInPandas(decode, schema)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, bytes) without decoding: the content column is pruned."""
    return sounds(spark, path).select(F.col("path").alias("series_id"), F.col("length").alias("bytes"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, channels, rate_hz, bits, duration_s, error) of every file, its samples undecoded; error says why one gives no frames.

    A file of no bytes gives no row, as Spark's file sources leave it out; nor does metadata() list it.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                sound, error = opened(content)
                told = [None] * 4 if sound is None else [sound.getnchannels(), sound.getframerate(), 8 * sound.getsampwidth(), sound.getnframes() / sound.getframerate()]
                yield pd.DataFrame([[name, *told, error]], columns=["series_id", "channels", "rate_hz", "bits", "duration_s", "error"], dtype=object)

    return sounds(spark, path).select("path", "content").mapInPandas(look, "series_id string, channels int, rate_hz int, bits int, duration_s double, error string")


def opened(content: bytes) -> tuple[wave.Wave_read | None, str | None]:
    """A sound at its start, or why it can't be read."""
    try:
        sound = wave.open(io.BytesIO(content))  # noqa: SIM115
    except (wave.Error, EOFError) as e:
        return None, f"not a PCM WAV file: {e or 'it ends early'}"
    if sound.getsampwidth() not in (1, 2, 3, 4) or not sound.getnchannels() or not sound.getframerate():
        return None, "not a PCM WAV file: odd sample width, channels or rate"
    return sound, None


def samples_of(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples by channels, within -1 and 1; 8 bits are unsigned, 24 bits are widened; half a sample at the end is dropped."""
    raw = raw[: len(raw) - len(raw) % (width * channels)]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        x = np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).view("<i4").ravel() / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return x.reshape(-1, channels)


def frames_of(name: str, content: bytes, frame: int, start_s: float = 0.0, end_s: float | None = None) -> Iterator[pd.DataFrame]:
    sound, _ = opened(content)
    if sound is None:
        return
    channels, width, rate = sound.getnchannels(), sound.getsampwidth(), sound.getframerate()
    hann, at = np.hanning(WINDOW + 1)[:-1], int(start_s * rate) // frame * frame
    if at >= sound.getnframes():
        return
    sound.setpos(at)
    while (end_s is None or at / rate < end_s) and len(x := samples_of(sound.readframes(frame), width, channels)):
        mono = np.zeros(WINDOW)
        mono[: min(WINDOW, len(x))] = x.mean(1)[:WINDOW]
        spectrum = np.abs(np.fft.rfft(mono * hann))[: WINDOW // 2]
        yield pd.DataFrame({"series_id": [name], "frame": [at // frame], "start_s": [at / rate], "sum_squares": [float((x * x).sum())], "samples": [x.size], "peak": [float(np.abs(x).max())], "rate_hz": [rate], "spectrum": [spectrum.tolist()]})
        at += len(x)


def synthetic_wav(seconds: float, rate: int = 44_100, tone_hz: float = 440.0, tone_db: float = -18.0, noise_db: float = -60.0, gap: tuple[float, float] = (0.0, 0.0)) -> bytes:
    """A tone with noise from a linear congruential generator and a silent gap (start, length), mono 16 bit."""
    n = int(seconds * rate)
    noise, x = np.empty(n), 12345
    for i in range(n):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        noise[i] = x / 2**31 - 1.0
    t = np.arange(n) / rate
    signal = 10 ** (tone_db / 20) * np.sin(2 * np.pi * tone_hz * t) + 10 ** (noise_db / 20) * noise
    signal[(t >= gap[0]) & (t < gap[0] + gap[1])] = 0.0
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(2)
        sound.setframerate(rate)
        sound.writeframes(np.clip(np.rint(signal * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def biquad(kind: str, frequency: float, rate: float, q: float = 0.707) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of the usual second-order low or high pass."""
    w = 2 * np.pi * frequency / rate
    alpha, c = np.sin(w) / (2 * q), np.cos(w)
    k = (1 - c) / 2 if kind == "lowpass" else (1 + c) / 2
    b = np.array([k, 2 * k if kind == "lowpass" else -2 * k, k])
    return b / (1 + alpha), np.array([1.0, -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)])


def filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A second-order recursive filter, transposed direct form II."""
    y, s1, s2 = np.empty_like(x), 0.0, 0.0
    for i, v in enumerate(x):
        o = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * o + s2, b[2] * v - a[2] * o
        y[i] = o
    return y


def band_level(x: np.ndarray, rate: float, low: float, high: float) -> float:
    """RMS in dB of a band: high pass at its low edge, low pass at its high edge."""
    y = filtered(filtered(x, *biquad("highpass", low, rate)), *biquad("lowpass", high, rate)) if high < rate / 2 else np.zeros(0)
    rms = float(np.sqrt((y * y).mean())) if len(y) else 0.0
    return 20 * np.log10(rms) if rms > 0 else float("-inf")
