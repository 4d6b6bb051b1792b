"""Published documents: nested records, JSON and JSON Lines without NaN, metric rows, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exprs as X

SCHEMA_VERSION = 1

#: Metrics of the report: key, label, unit, decimals, meaning.
METRICS = (
    ("rms_level", "RMS level", "dBFS", 1, "mean level of the series"),
    ("peak_level", "Peak level", "dBFS", 1, "highest level of any interval"),
    ("momentary", "Momentary loudness", "LUFS", 1, "mean momentary loudness"),
    ("kurtosis", "Kurtosis", "", 4, "peakedness of the spectrum"),
    ("flatness", "Flatness", "", 4, "noise-like against tonal"),
    ("flux", "Flux", "", 4, "change between intervals"),
)


def without_nan(column: Column, kind: T.DataType) -> Column:
    """The column with every NaN and infinity at any depth replaced by null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(X.is_finite(column), column)
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(without_nan(column[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda v: without_nan(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: without_nan(v, kind.valueType))
    return column


def sanitised(df: DataFrame) -> DataFrame:
    return df.select(*(without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def seconds_from_nanos(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces <name>_ns columns by <name>_s in seconds."""
    for c in columns:
        df = df.withColumn(c.removesuffix("_ns") + "_s", F.col(c) / 1e9).drop(c)
    return df


def records(series: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """One nested record a series: schema_version, series_id and a struct a domain, null where none of it was measured."""
    parts = [F.when(F.coalesce(*(F.col(c).cast("string") for c in cols)).isNotNull(), F.struct(*cols)).alias(name) for name, cols in domains.items()]
    return sanitised(series.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "series_id", *parts))


def record_json(nested: DataFrame, pretty: bool = False) -> DataFrame:
    return nested.select("series_id", F.to_json(F.struct(*nested.columns), {"pretty": str(pretty).lower(), "ignoreNullFields": "true"}).alias("json"))


def write_json_lines(df: DataFrame, path: str, kind: str | None = None) -> None:
    """JSON Lines with NaN as null, and a leading kind where one is given; Spark's committer publishes whole files only."""
    tagged = df if kind is None else df.select(F.lit(kind).alias("kind"), *df.columns)
    sanitised(tagged).write.mode("overwrite").json(path)


def metric_rows(stages: DataFrame) -> DataFrame:
    """(series_id, metric, input, filtered, final) from one row a series and stage; a stage without rows leaves null."""
    keys = [m[0] for m in METRICS]
    long = stages.select("series_id", "stage", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in keys))).alias("m"))
    return long.groupBy("series_id", F.col("m.metric").alias("metric")).pivot("stage", ["input", "filtered", "final"]).agg(F.first("m.value"))


def described(rows: DataFrame) -> DataFrame:
    """Metric rows with label, unit, meaning and formatted cells; an unknown metric keeps its key and has - as meaning."""
    names = rows.sparkSession.createDataFrame([(k, label, unit, d, text) for k, label, unit, d, text in METRICS], "metric string, label string, unit string, decimals int, meaning string")
    out = rows.join(F.broadcast(names), "metric", "left")  # a fixed table of few rows
    cell = lambda c: F.when(F.col(c).isNull(), "-").when(F.col("unit") == "dBFS", X.metric_db(F.col(c))).when(F.col("unit") == "LUFS", X.metric_lufs(F.col(c))).otherwise(X.metric(F.col(c), 4))
    return out.select("series_id", "metric", F.coalesce("label", "metric").alias("label"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("meaning", F.lit("-")).alias("meaning"), *(cell(c).alias(c) for c in ("input", "filtered", "final")))


def escape_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.when(c == "", "-").otherwise(F.coalesce(c, F.lit("-"))), r"\|", r"\\|"), r"[\r\n]+", " ")


def markdown_table(described_rows: DataFrame) -> DataFrame:
    """(series_id, markdown): a table a series, its rows in the order of the labels."""
    cols = ("label", "input", "filtered", "final", "unit", "meaning")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(escape_cell(F.col(c)) for c in cols)), F.lit(" |"))
    body = described_rows.groupBy("series_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    head = "| Metric | Input | Filtered | Final | Unit | Meaning |\n|---|---|---|---|---|---|\n"
    return body.select("series_id", F.concat(F.lit(head), "body").alias("markdown"))


def report(sections: DataFrame) -> DataFrame:
    """(series_id, markdown) from (series_id, place, heading, body): sections in order, empty ones dropped, blank lines between."""
    kept = sections.where("body IS NOT NULL AND body <> ''").select("series_id", F.struct("place", F.concat(F.lit("## "), "heading", F.lit("\n\n"), "body").alias("text")).alias("s"))
    return kept.groupBy("series_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]), "\n\n").alias("markdown"))


def output_name(path: Column, integrated: Column) -> Column:
    """The path without its ending, with the loudness, as FLAC whatever it was."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(stem, F.lit("-LUFS-"), F.round(F.abs(integrated)).cast("int").cast("string"), F.lit("-processed.flac"))


def analysis_name(path: Column) -> Column:
    """<stem>-<extension>-analysis.md of a file name."""
    return F.concat_ws("-", F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.nullif(F.regexp_extract(path, r"\.([^./]*)$", 1), F.lit("")), F.lit("analysis.md"))


def image_names(elected: DataFrame, stages: tuple[str, ...] = ("input", "filtered", "final")) -> DataFrame:
    """(series_id, kind, stage, name): whole, room tone and speech images of every stage, kinds only where a region was elected."""
    kinds = F.filter(F.array(F.lit("whole"), F.when(F.col("has_room_tone"), "roomtone"), F.when(F.col("has_speech"), "speech")), lambda k: k.isNotNull())
    both = elected.select("series_id", F.explode(kinds).alias("kind"), F.array(*map(F.lit, stages)).alias("stages")).select("series_id", "kind", F.explode("stages").alias("stage"))
    return both.withColumn("name", F.concat("series_id", F.lit(".spectrogram-"), "kind", F.lit("-"), "stage", F.lit(".png")))
