"""Readers of interval rows, statistics in log text, and metadata maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPECTRAL = ("mean", "variance", "centroid", "spread", "skewness", "kurtosis", "entropy", "flatness", "crest", "flux", "slope", "decrease", "rolloff")
FIELDS = "series_id string, timestamp long, rms_level double, peak_level double, momentary_lufs double, short_term_lufs double, true_peak double, sample_peak double"


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of flat interval rows; found tells whether any spectral_* key was there."""
    rows = spark.read.schema(FIELDS + "".join(f", spectral_{s} double" for s in SPECTRAL)).json(path)
    names = [f"spectral_{s}" for s in SPECTRAL]
    spectral = F.struct(*(F.coalesce(F.col(n), F.lit(0.0)).alias(s) for n, s in zip(names, SPECTRAL)))
    found = F.coalesce(*names).isNotNull()
    return rows.withColumn("found", found).withColumn("spectral", F.when(found, spectral)).drop(*names)


def stats_from_text(text: Column) -> Column:
    """The outermost {...} of a text as a map of texts; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>")


def number(values: Column, key: str) -> Column:
    """A map's text as a number; null where it is missing or none."""
    return F.get(F.array(values[key]), F.lit(0)).try_cast("double")


def last_values(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(series_id, <keys>): the last known number of each key of a metadata map; only if any is known."""
    values = [F.max_by(F.col("metadata")[k].try_cast("double"), F.when(F.col("metadata")[k].try_cast("double").isNotNull(), F.col(order))).alias(k) for k in keys]
    return rows.groupBy("series_id").agg(*values)
