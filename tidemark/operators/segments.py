"""Segmentation of each series: gap tolerance, hysteresis runs, quiet runs and sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.exprs import passes_veto
from tidemark.operators.intervals import in_regions
from tidemark.operators.levels import nearest_rank, ordered

def by_time():
    return Window.partitionBy("series_id").orderBy("ts")


def speech_flags(intervals: DataFrame, limits: DataFrame, axis: str = "momentary") -> DataFrame:
    """Interval rows with their series' split and margin and whether they count as speech."""
    rows = intervals.join(limits.select("series_id", "split", "margin"), "series_id")
    return rows.withColumn("veto_ok", passes_veto(F.col("centroid"), F.col("entropy"))).withColumn("speech", F.coalesce(~F.isnan(axis) & (F.col(axis) >= F.col("split")) & F.col("veto_ok"), F.lit(False)))


def gap_tolerance(flags: DataFrame, bounds: tuple[int, int] = C.GAP_HOPS) -> DataFrame:
    """(series_id, tolerance): a high percentile of the lengths of gaps between speech, within bounds."""
    island = flags.withColumn("before", F.sum(F.col("speech").cast("long")).over(by_time())).withColumn("total", F.sum(F.col("speech").cast("long")).over(Window.partitionBy("series_id")))
    inner = ~F.col("speech") & (F.col("before") > 0) & (F.col("before") < F.col("total"))
    gaps = island.groupBy("series_id", "before").agg(F.sum(F.when(inner, 1)).alias("gap"))
    p = gaps.groupBy("series_id").agg(ordered(F.col("gap")).alias("gaps"))
    return p.select("series_id", F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.round(nearest_rank(F.col("gaps"), C.GAP_PERCENTILE)).cast("int"))).cast("long").alias("tolerance"))


FOLD = """
aggregate(items,
  named_struct('on', false, 'start', 0L, 'n', 0L, 'last', 0L, 'gap', 0L, 'runs', cast(array() AS array<struct<start:bigint, last:bigint, n:bigint>>)),
  (s, x) -> CASE
    WHEN NOT s.on THEN IF(x.level >= split + margin AND x.ok, named_struct('on', true, 'start', x.ts, 'n', 1L, 'last', x.ts, 'gap', 0L, 'runs', s.runs), s)
    WHEN x.level >= split AND x.ok THEN named_struct('on', true, 'start', s.start, 'n', s.n + 1, 'last', x.ts, 'gap', 0L, 'runs', s.runs)
    WHEN x.level >= split OR (x.level < split - margin AND s.gap + 1 > tolerance)
      THEN named_struct('on', false, 'start', 0L, 'n', 0L, 'last', 0L, 'gap', 0L, 'runs', array_append(s.runs, struct(s.start AS start, s.last AS last, s.n AS n)))
    WHEN x.level < split - margin THEN named_struct('on', true, 'start', s.start, 'n', s.n, 'last', s.last, 'gap', s.gap + 1, 'runs', s.runs)
    ELSE s END,
  s -> IF(s.on, array_append(s.runs, struct(s.start AS start, s.last AS last, s.n AS n)), s.runs))
"""


def speech_runs(flags: DataFrame, tolerance: DataFrame, hop_s: int, least: int = C.RUN_HOPS, axis: str = "momentary") -> DataFrame:
    """(series_id, start, end, intervals): runs of the hysteresis state machine with at least so many speech intervals.

    A run starts at split + margin, goes on at split, is held between split - margin and split, bridges up to tolerance
    lower intervals, and ends at once at a loud interval that the veto rejects; it lasts to its last speech interval. One
    fold over a series in time order; a NaN level is held.
    """
    level = F.when(~F.isnan(axis), F.col(axis))
    items = flags.groupBy("series_id", "split", "margin").agg(F.sort_array(F.collect_list(F.struct("ts", level.alias("level"), F.col("veto_ok").alias("ok")))).alias("items"))
    runs = items.join(tolerance, "series_id").select("series_id", F.expr(f"inline({FOLD})"))
    return runs.where(F.col("n") >= least).select("series_id", "start", (F.col("last") + hop_s).alias("end"), F.col("n").alias("intervals"))


def quiet_run(flags: DataFrame, hop_s: int, axis: str = "momentary") -> DataFrame:
    """(series_id, start, end): the longest run below the split; the earliest of equals."""
    below = flags.withColumn("i", F.row_number().over(by_time())).where(F.col(axis) < F.col("split"))
    below = below.withColumn("island", F.col("i") - F.row_number().over(by_time()))
    runs = below.groupBy("series_id", "island").agg(F.min("ts").alias("start"), (F.max("ts") + hop_s).alias("end"))
    best = runs.groupBy("series_id").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("first"))).alias("b"))
    return best.select("series_id", (-F.col("b.first")).alias("start"), (F.col("b.length") - F.col("b.first")).alias("end"))


def refine(intervals: DataFrame, regions: DataFrame, hop_s: int, window: int, minimum: int, score: Callable[[Window], Column], lowest: bool) -> DataFrame:
    """Regions (series_id, start, end) cut to their best window of intervals, with refined.

    score(window) is any column over a row frame; the first of the best windows wins. Regions not longer than the window,
    or with fewer intervals than the minimum, stay as they are.
    """
    rows = in_regions(intervals, regions.where((F.col("end") - F.col("start")) > window * hop_s))
    frame = Window.partitionBy("series_id", "start").orderBy("ts").rowsBetween(0, window - 1)
    every = Window.partitionBy("series_id", "start")
    rows = rows.withColumn("held", F.count("*").over(frame)).withColumn("n", F.count("*").over(every)).withColumn("size", F.least(F.col("n"), F.lit(window)))
    scored = rows.withColumn("score", F.round(score(frame), 9)).where((F.col("held") == F.col("size")) & (F.col("n") >= minimum))
    sign = -1.0 if lowest else 1.0
    best = scored.groupBy("series_id", "start").agg(F.max(F.struct((F.col("score") * sign).alias("s"), (-F.col("ts")).alias("t"), "size")).alias("b"))
    best = best.select("series_id", "start", (-F.col("b.t")).alias("best_start"), (F.col("b.size") * hop_s - F.col("b.t")).alias("best_end"))
    out = regions.join(best, ["series_id", "start"], "left")
    return out.select("series_id", F.coalesce("best_start", "start").alias("start"), F.coalesce("best_end", "end").alias("end"), F.col("best_start").isNotNull().alias("refined"), F.col("start").alias("original_start"), F.col("end").alias("original_end"))
