"""Packs token sequences into as few windows as it can: linear grouping, few-size configurations, best fit.

Everything is planned on the histogram of lengths, which has at most CAPACITY entries whatever the corpus size:

1. lengths above SMALL are ordered and cut into GROUPS groups of equal cardinality; each counts as its group's largest;
2. the few rounded sizes are packed by the configuration LP (column generation with a knapsack), rounded down;
3. actual lengths take the slots of their group, so a configuration becomes runs: equal sequences and how many;
4. what is left, large and small, goes best-fit decreasing into the runs with the smallest sufficient rest.

A run's slot is a range of ranks within one length, so any piece finds its place from (length, rank) alone, and
ranks come from per-partition counts: no task ever holds all pieces of a length.

Edge cases: a null or empty text is one piece that holds the end id only; an empty table gives no rows; repeated
doc_ids are separate documents; ties in length are broken by the order of the input partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small, table
from tidemark.llm.pieces import GROUP, column_encoder, forget

CAPACITY = 4096
SMALL = CAPACITY // 8
GROUPS = 40


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = sizes <= c
        got = np.where(fits, best[np.where(fits, c - sizes, 0)] + value, -1.0)
        k = int(got.argmax())
        best[c], last[c] = (got[k], k) if got[k] > best[c - 1] else (best[c - 1], -2)
    taken, c = np.zeros(len(sizes)), capacity
    while c > 0 and last[c] != -1:
        if last[c] == -2:
            c -= 1
        else:
            taken[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used: the LP optimum by column generation, rounded down."""
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(rounds):
        value, column = best_configuration(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(0, used - ratio[out] * step)
        used[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].astype(int), int(used[j] + 1e-9)) for j in range(len(sizes)) if used[j] >= 1 - 1e-9]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int | None = None, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Runs (how many sequences, lengths in each) that hold the histogram's items exactly once."""
    small = capacity // 8 if small is None else small
    left = {n: c for n, c in histogram.items() if c > 0}
    runs = [(left.pop(capacity), [capacity])] if capacity in left else []
    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    cut_at, members, sizes = max(1, -(-total // groups)), [], []
    for n in large:
        c = left[n]
        while c:
            if not members or sum(x[1] for x in members[-1]) >= cut_at:
                members.append([])
                sizes.append(n)
            take = min(c, cut_at - sum(x[1] for x in members[-1]))
            members[-1].append([n, take])
            c -= take
    open_runs: list[tuple[int, list[int]]] = []
    if members:
        demand = np.array([sum(c for _, c in m) for m in members], float)
        for config, times in configurations(np.array(sizes), demand, capacity):
            slots = []
            for g, a in enumerate(config):
                for _ in range(a):
                    taken, need = [], times
                    while need and members[g]:
                        n, c = members[g][0]
                        t = min(need, c)
                        taken.append((n, t))
                        need -= t
                        members[g][0][1] -= t
                        if not members[g][0][1]:
                            members[g].pop(0)
                    slots.append(taken + [(0, need)] * (need > 0))
            ends = sorted({e for s in slots for e in np.cumsum([t for _, t in s]).tolist()})
            at, where = 0, [[0, 0] for _ in slots]
            for e in ends:
                lengths = []
                for s, w in zip(slots, where):
                    while w[1] + s[w[0]][1] <= at:
                        w[1] += s[w[0]][1]
                        w[0] += 1
                    if s[w[0]][0]:
                        lengths.append(s[w[0]][0])
                if lengths:
                    open_runs.append((e - at, lengths))
                at = e
    rest: dict[int, int] = defaultdict(int)
    for m in members:
        for n, c in m:
            rest[n] += c
    for n, c in left.items():
        if n <= small:
            rest[n] += c
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    free: list[int] = []

    def put(times: int, lengths: list[int], r: int) -> None:
        if r == 0:
            runs.append((times, lengths))
            return
        if not room[r]:
            insort(free, r)
        room[r].append((times, lengths))

    for times, lengths in open_runs:
        put(times, lengths, capacity - sum(lengths))
    for n in sorted(rest, reverse=True):
        c = rest[n]
        while c:
            i = bisect_left(free, n)
            if i == len(free):
                put(-(-c // (capacity // n)), [], capacity)
                i = bisect_left(free, n)
            r = free[i]
            times, lengths = room[r].pop()
            if not room[r]:
                free.pop(i)
            t = min(times, c)
            if t < times:
                put(times - t, lengths, r)
            put(t, [*lengths, n], r - n)
            c -= t
    return runs + [x for r in room for x in room[r] if x[1]]


class Places:
    """The plan as arrays by length: ranks from .. go to sequences from .. at one offset."""

    def __init__(self, runs: list[tuple[int, list[int]]]):
        rows, base, used = defaultdict(list), 0, defaultdict(int)
        for times, lengths in runs:
            offset = 0
            for n in lengths:
                rows[n].append((used[n], base, offset))
                used[n] += times
                offset += n
            base += times
        self.sequences, self.rows = base, {n: np.array(x, np.int64).T for n, x in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            first, base, at = self.rows[int(length[part[0]])]
            i = np.searchsorted(first, rank[part], "right") - 1
            sequence[part], offset[part] = base[i] + rank[part] - first[i], at[i]
        return sequence, offset


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most capacity tokens, with its partition and its number among equals there."""

    def cut_up(batches):
        from pyspark import TaskContext

        encode, part, seen = column_encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in small(batches, 2 * GROUP):
            ids, counts = encode(batch.column("text"))
            ids, counts = np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            k = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
            length = np.minimum(capacity, counts[doc] - k * capacity)
            end = np.cumsum(length)
            crc = [zlib.crc32(ids[lo:hi]) for lo, hi in zip((end - length).tolist(), end.tolist())]
            order, here = np.argsort(length, kind="stable"), np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(doc), np.int64)
            nth[order] = seen[length[order]] + np.arange(len(doc)) - (np.cumsum(here) - here)[length[order]]
            seen += here
            numbers = (k, k * capacity, length, np.array(crc, np.int64), np.full(len(doc), part), nth)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), *map(pa.array, numbers)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        del encode  # a pipeline's other stages run in the same workers
        forget(vocabulary)

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece long, start long, length long, ids_crc32 long, part long, nth long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length, part and nth (see token_pieces)."""
    spark = pieces.sparkSession
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    kept = [c for c in ranked.columns if c != "rank"]

    def place(batches):
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    found = pack(cut(token_pieces(docs, vocabulary, end_id, capacity)), capacity)
    return found.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
