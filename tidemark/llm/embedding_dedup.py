"""Near-duplicate vectors by iterative quantisation (ITQ) and multi-index Hamming tables.

Rotations for balanced binary codes are learnt on at most SAMPLE vectors (those with the smallest hashes of their ids;
centred, principal directions, then ITQ's alternation of signs and Procrustes). Every vector is indexed: each table is a
Hamming table with a key of about log2(vectors) - SPARE bits. Tables on one code share no bits, and when a code's bits
are used up the next tables get a code of another rotation, so a pair that is unlucky in one code is not so in all. How
often pairs at the threshold meet is measured, after centring, on PAIRS made from the sample (moved off at random, and
along differences of sample vectors): tables are added until RECALL of either kind meet, with narrower keys where more
than MOST tables would be needed, and if four times as many do not do, all vectors are compared with all. Pairs that meet in a table are reranked with the original vectors
by cosine in double precision. A pair counts in the first table where it meets, so links are neither lost nor counted
twice, and no list of pairs leaves a task: it sends link counts, and links enough to connect what it saw.

A bucket larger than BLOCK is cut into blocks that are compared block with block, so no task gets an unbounded bucket.

Equal vectors are compared as one, whose copies count, so a group of copies has no pairs. Vectors of each length that
occurs are searched apart, as only equal lengths have a cosine.

Edge cases: vectors that are null, zero or that hold null or non-finite components link with nothing and are their own
component; an empty table gives no rows; rows without vec_id are dropped; rows with the same vec_id count as one vector
(the least that can link), each getting the result; equal vectors link. Other columns are never read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, table

THRESHOLD = 0.9
RECALL = 0.97
SAMPLE = 20_000
SPARE = 4
PAIRS = 4_000
MOST = 256
#: Sample vectors that the alternation runs on, at most half of them: recall is measured on the others, as planes lie farther from vectors they were fitted to.
ALTERNATE = 5_000
BLOCK = 512
ROUNDS = 30
SEED = 7
USABLE = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"


def rotations(sample: np.ndarray, bits: int, rounds: int = ROUNDS):
    """The mean, then without end projections of ITQ: code = projected sign. sample: unit rows."""
    rng = np.random.default_rng(SEED)
    d = sample.shape[1]
    if len(sample) < 2:
        yield np.zeros(d)
        while True:
            yield np.linalg.qr(rng.normal(size=(d, d)))[0][:, :bits]
    mean = sample.mean(0)
    yield mean
    centred = sample - mean
    _, basis = np.linalg.eigh(centred.T @ centred)
    directions = basis[:, ::-1][:, :bits]
    v = centred[: min(ALTERNATE, -(-len(sample) // 2))] @ directions
    while True:
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        yield directions @ r


def threshold_pairs(sample: np.ndarray, threshold: float, n: int = PAIRS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold, the first from the sample: one half moved off at random, the other along differences of sample vectors."""
    rng = np.random.default_rng(seed)
    a, b, c = sample[rng.integers(0, len(sample), (3, n))]
    random = rng.normal(size=a.shape)
    off = np.where((np.arange(n) < n // 2)[:, None] | (np.abs(b - c).max(1, keepdims=True) < 1e-9), random, b - c)
    off -= (off * a).sum(1, keepdims=True) * a
    flat = np.abs(off).max(1) < 1e-9  # along the vector itself, or one dimension only
    off[flat] = a[flat]
    return a, np.where(flat[:, None], a, threshold * a + math.sqrt(1 - threshold * threshold) * unit(off))


def design(vectors: int, bits: int, threshold: float, recall: float, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, planes, width): the key of table t holds the sides of planes t * width and on. sample: unit rows."""
    codes = rotations(sample, bits)
    mean = next(codes)
    width = int(min(bits, 30, max(6, math.ceil(math.log2(max(vectors, 2))) - SPARE)))
    if not len(sample):
        return mean, next(codes)[:, :width], width
    a, b = (x - mean for x in threshold_pairs(sample[min(ALTERNATE, len(sample) // 2) :], threshold))
    learnt = [next(codes) for _ in range(4)]
    same = np.concatenate([(a @ p >= 0) == (b @ p >= 0) for p in learnt], 1).mean(1)
    while width > 1 and (1 - (1 - same**width) ** MOST).mean() < recall:
        width -= 1
    met, tables = np.zeros(len(a), bool), []
    while len(tables) < 4 or min(met[: len(a) // 2].mean(), met[len(a) // 2 :].mean()) < recall:
        if len(tables) > 4 * MOST:  # next to no spread around the mean: one table with one bucket, every pair is compared
            return mean, np.zeros((len(mean), 1)), 1
        p = learnt.pop(0) if learnt else next(codes)
        agree = (a @ p >= 0) == (b @ p >= 0)
        order = np.random.default_rng([SEED, len(tables)]).permutation(bits)
        for lo in range(0, bits - width + 1, width):
            tables.append(p[:, order[lo : lo + width]])
            met |= agree[:, order[lo : lo + width]].all(1)
            if len(tables) >= 4 and min(met[: len(a) // 2].mean(), met[len(a) // 2 :].mean()) >= recall:
                break
    return mean, np.concatenate(tables, 1), width


def keys_of(x: np.ndarray, mean: np.ndarray, planes: np.ndarray, width: int) -> np.ndarray:
    """The key of each unit vector in each table."""
    signs = (x - mean) @ planes >= 0
    return signs.reshape(len(x), planes.shape[1] // width, width) @ (1 << np.arange(width, dtype=np.int64))


def usable(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can link, and their vectors as float64."""
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and (dim is None or len(v) == dim) and None not in v:
            a = np.array(v, np.float64)
            if np.isfinite(a).all() and a.any():
                rows.append(i)
                out.append(a)
    return np.array(rows, np.int64), out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """Union-find over the vectors of one task's cell; gives back the links that first connected two parts."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = int(self.root[x])
        return x

    def spanning(self, a: np.ndarray, b: np.ndarray):
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                yield x, y


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    once = rows.where(USABLE).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    named = once.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64("embedding", "h"))
    classes = cut(named.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("embedding").alias("embedding")))
    lengths = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()  # one row a length
    found = [search(classes.where(F.size("embedding") == r.dim).selectExpr("rep AS vec_id", "copies", "embedding"), r.dim, r.n, threshold, recall) for r in lengths]
    none = classes.where("false").selectExpr("rep AS a", "copies AS n", "rep AS b")
    found = cut(functools.reduce(DataFrame.unionByName, found, none))
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    label = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.join(links, "rep", "left").join(label, "rep", "left")
    known = cut(known.select("h", "g", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("label", "rep").alias("component_id")))
    # At most 4096 vectors can each stand for more than a 4096th of all rows; the rows of any other one fit one task.
    most, members = rows.count() // 4096 + 1, named.select("vec_id", "h", "g")
    hot, other = F.broadcast(known.where(F.col("copies") > most).drop("copies")), known.where(F.col("copies") <= most).drop("copies")
    result = members.join(hot, ["h", "g"]).unionByName(members.join(hot, ["h", "g"], "left_anti").join(other, ["h", "g"]))
    out = rows.select("vec_id").join(result, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def search(vectors: DataFrame, dim: int, count: int, threshold: float, recall: float) -> DataFrame:
    """(a, n, b) of distinct vectors (vec_id, copies, embedding) of one length: vector a has links to n vectors, copies counted, or a links with b."""
    spark = vectors.sparkSession
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
    picked = usable(pa.array([r.embedding for r in some.collect()]), dim)[1]  # at most SAMPLE vectors
    model = spark.sparkContext.broadcast(design(count, min(dim, 64), threshold, recall, unit(np.array(picked)) if picked else np.zeros((0, dim))))

    def index(batches):
        mean, planes, width = model.value
        for batch in batches:
            good, x = usable(batch.column("embedding"), dim)
            if not len(good):
                continue
            x = np.array(x)
            keys = keys_of(unit(x), mean, planes, width)
            ids, t = batch.column("vec_id").to_numpy()[good], keys.shape[1]
            data, copies = [v.tobytes() for v in x], batch.column("copies").to_numpy()[good]
            for lo in range(0, len(good), 256):
                hi = min(lo + 256, len(good))
                yield pa.RecordBatch.from_pydict({"t": np.tile(np.arange(t), hi - lo), "key": keys[lo:hi].ravel(), "vec_id": np.repeat(ids[lo:hi], t), "copies": np.repeat(copies[lo:hi], t), "vector": pa.array([d for d in data[lo:hi] for _ in range(t)], pa.binary())})

    indexed = vectors.mapInArrow(index, "t long, key long, vec_id long, copies long, vector binary")
    sizes = cut(indexed.groupBy("t", "key").agg(F.count("*").alias("n")).where(f"n > {BLOCK}"))
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("long")
    placed = indexed.join(sizes, ["t", "key"], "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vec_id"), "blocks"))
    cells = placed.select("t", "key", "vec_id", "copies", "vector", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    cells = cells.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "vec_id", "copies", "vector")

    def compare(group):
        mean, planes, width = model.value
        order = np.argsort(group.column("vec_id").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        ids, own, copies = (group.column(c).to_numpy() for c in ("vec_id", "own", "copies"))
        lo, hi, t = (group.column(c)[0].as_py() for c in ("lo", "hi", "t"))
        x = unit(np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float64).reshape(len(ids), dim))
        keys = keys_of(x, mean, planes[:, : t * width], width)
        left, right = (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        for at in range(0, len(left), BLOCK):
            part = left[at : at + BLOCK]
            a, b = np.nonzero(x[part] @ x[right].T >= threshold - 1e-9)
            a, b = part[a], right[b]
            keep = a < b if lo == hi else a != b
            a, b = a[keep], b[keep]
            for k in range(0, len(a), 1 << 16):
                i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[exact], j[exact]
                edges += forest.spanning(i, j)
                first = ~(keys[i] == keys[j]).any(1)
                np.add.at(links, i[first], copies[j[first]])
                np.add.at(links, j[first], copies[i[first]])
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[some], ids[e[:, 0]]))), pa.array(np.concatenate((links[some], np.zeros(len(e), np.int64)))), pa.array([None] * len(some) + ids[e[:, 1]].tolist(), pa.int64())], names=["a", "n", "b"])

    def compare_table(group):
        return pa.Table.from_batches(list(compare(group.combine_chunks())))

    return cells.groupBy("t", "key", "lo", "hi").applyInArrow(compare_table, "a long, n long, b long")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
