"""Thirteen statistics of a magnitude spectrum, as expressions over an array column; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07
ROLLOFF_SHARE = 0.85


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def weighted(m: Column, weight) -> Column:
    """Sum of weight(magnitude, bin)."""
    return total(F.transform(m, lambda v, i: weight(v, i.cast("double"))))


def spectral_statistics(frames: DataFrame, rate_hz: float, order: str, spectrum: str = "spectrum", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds the statistics to frames (series_id, <order>, <spectrum> array<double>); flux is to the frame before in the series."""
    m, n = F.col("m"), F.col("bins")
    df = frames.withColumn("m", F.col(spectrum)).withColumn("before", F.lag(spectrum).over(Window.partitionBy("series_id").orderBy(order)))
    df = df.withColumn("bins", F.size("m")).withColumn("scale", F.lit(rate_hz / 2) / F.nullif(n, F.lit(0))).withColumn("sum", total(m)).withColumn("mean", F.try_divide("sum", n))
    safe = lambda top, bottom, other: F.coalesce(F.try_divide(top, bottom), F.lit(other))
    df = df.withColumn("centroid", safe(weighted(m, lambda v, i: v * i * F.col("scale")), F.col("sum"), 1.0))
    away = lambda i: i * F.col("scale") - F.col("centroid")
    df = df.withColumn("spread", F.sqrt(safe(weighted(m, lambda v, i: v * away(i) * away(i)), F.col("sum"), 1.0)))
    half = n / 2
    cumulated = F.aggregate(m, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bin"), F.lit(-1).alias("found")), lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["bin"] + 1).alias("bin"), F.when((a["found"] < 0) & (a["sum"] + v >= ROLLOFF_SHARE * F.col("sum")), a["bin"]).otherwise(a["found"]).alias("found")))
    cube = F.col("spread") * F.col("spread") * F.col("spread")
    return df.select(
        "series_id", order, *keep, "mean", F.try_divide(weighted(m, lambda v, i: (v - F.col("mean")) * (v - F.col("mean"))), n).alias("variance"), "centroid", "spread",
        safe(weighted(m, lambda v, i: v * away(i) * away(i) * away(i)), F.col("sum") * cube, 1.0).alias("skewness"),
        safe(weighted(m, lambda v, i: v * away(i) * away(i) * away(i) * away(i)), F.col("sum") * cube * F.col("spread"), 1.0).alias("kurtosis"),
        safe(-weighted(m, lambda v, i: v * F.ln(v + EPSILON)), F.ln(F.when(n > 1, n.cast("double"))), 1.0).alias("entropy"),
        safe(F.exp(F.try_divide(weighted(m, lambda v, i: F.ln(v + EPSILON)), n)), F.try_divide(weighted(m, lambda v, i: v + EPSILON), n), 0.0).alias("flatness"),
        safe(F.array_max(m), F.col("mean"), 0.0).alias("crest"),
        F.sqrt(F.when(F.col("before").isNull(), weighted(m, lambda v, i: v * v)).otherwise(total(F.zip_with(m, F.col("before"), lambda a, b: (F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) * (F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))))).alias("flux"),
        safe(weighted(m, lambda v, i: (i - half) / half * (v - F.col("mean"))), weighted(m, lambda v, i: (i - half) / half * ((i - half) / half)), 0.0).alias("slope"),
        safe(weighted(m, lambda v, i: F.when(i > 0, (v - F.get(m, F.lit(0))) / i).otherwise(0.0)), F.col("sum") - F.get(m, F.lit(0)), 0.0).alias("decrease"),
        F.when(cumulated["found"] >= 0, cumulated["found"] * F.col("scale")).otherwise(0.0).alias("rolloff"),
    )
