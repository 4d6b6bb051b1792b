"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each is a logistic regression over the presence of words and word beginnings,
plus the probabilities of the categories before it. In training those are out-of-fold predictions (FOLDS folds by the
crc32 of doc_id), so a later model learns from probabilities as good as those it will get; in use they come from the
models fitted on all training rows.

The labels say toxic or not. The categories before that one are KINDS kinds of toxic texts, learnt from the labelled ones by
spherical k-means over their features, so no list of words is given. Training uses at most SAMPLE labelled rows, those with
the smallest hashes of their doc_id; features are counted and chosen on the executors, so that a labelled row brings at most
FEATURES numbers to the driver, whatever its length. Everything else covers all rows.

Edge cases: a null or empty text has no features and gets the intercepts; without labelled rows of both classes nothing is
learnt and every probability is 0; rows with the same doc_id are judged one by one, and where several are labelled each is
a training row; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, null_safe_texts, small, table, words_of

SAMPLE = 8_000
FOLDS = 5
HEAD = 5
FEATURES = 2_000
LEAST_TEXTS = 4
LEAST_LIFT = 4.0
REJECT_FROM = 0.5
CHUNK = 1 << 18

KINDS = 2
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")


#: ASCII punctuation separates words as white space does.
SEPARATE = bytes(32 if 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 else b for b in range(256))


def text_features(texts: list[str]):
    """Yields (first index, bounds of the texts' words, 64-bit hashes of words and of their first HEAD bytes), A-Z folded."""
    raw = [t.encode("utf-8", "surrogatepass").translate(SEPARATE) for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) < CHUNK):
            size += len(raw[hi])
            hi += 1
        begin = np.cumsum([0, *(len(r) + 1 for r in raw[lo:hi])])
        start, _, word, head = words_of(np.frombuffer(b" ".join(raw[lo:hi]), np.uint8), True, HEAD)
        yield lo, np.searchsorted(start, begin), word, head
        lo = hi


def fit(rows: np.ndarray, cols: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray, features: int, steps: int = 250) -> np.ndarray:
    """Weights (features, extra columns, intercept) of an L2-penalised logistic regression over sparse presence."""
    w, speed = np.zeros(features + extra.shape[1] + 1), np.zeros(features + extra.shape[1] + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1.001 - y.mean()))
    df = np.bincount(cols, minlength=features)
    scale = np.concatenate((df, (extra**2).sum(0), [n])) / 4 + 1.0
    for step in range(steps):
        z = np.bincount(rows, weights=w[cols], minlength=n) + extra @ w[features:-1] + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        g = np.concatenate((np.bincount(cols, weights=r[rows], minlength=features), extra.T @ r, [r.sum()])) + 0.3 * np.append(w[:-1], 0)
        speed = 0.9 * speed - 0.5 * g / scale
        w = w + speed
    return w


def apply(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
    k = len(w) - extra.shape[1] - 1
    z = np.bincount(rows, weights=w[cols], minlength=n) + extra @ w[k:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Chain:
    """Selected feature hashes and one weight vector a category, each over the probabilities before it."""

    def __init__(self, hashes: np.ndarray, weights: list[np.ndarray]):
        self.hashes, self.weights = hashes, weights

    def columns(self, found: np.ndarray) -> np.ndarray:
        """Column of each hash, -1 where it is none of the features."""
        if not len(self.hashes):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return np.where(self.hashes[at] == found, at, -1)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a category."""
        if not self.weights:
            return np.zeros((len(texts), len(CATEGORIES)))
        pairs = []
        for lo, bound, word, head in text_features(texts):
            owner = lo + np.repeat(np.arange(len(bound) - 1), np.diff(bound))
            for h in (word, head):
                c = self.columns(h)
                hit = c >= 0
                pairs.append(np.stack((owner[hit], c[hit]), 1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        out = np.zeros((len(texts), 0))
        for w in self.weights:
            out = np.column_stack((out, apply(w, pairs[:, 0], pairs[:, 1], len(texts), out)))
        return out

    @classmethod
    def learnt(cls, hashes: np.ndarray, rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> Chain:
        """hashes: the features, ascending; rows, cols: which training row has which feature."""
        n = len(toxic)
        if not n or toxic.min() == toxic.max():
            return cls(np.empty(0, np.uint64), [])
        kind = kinds(rows, cols, toxic, len(hashes))
        before, weights = np.zeros((n, 0)), []
        for c in range(len(CATEGORIES)):
            y = (kind == c).astype(float) if c < KINDS else toxic.astype(float)
            held = np.zeros(n)
            for k in range(FOLDS):
                train, test = fold != k, fold == k
                if train.any() and test.any():
                    here = train[rows]
                    renumber = np.cumsum(train) - 1
                    w = fit(renumber[rows[here]], cols[here], int(train.sum()), before[train], y[train], len(hashes))
                    held[test] = apply(w, rows, cols, n, before)[test]
            weights.append(fit(rows, cols, n, before, y, len(hashes)))
            before = np.column_stack((before, held))
        return cls(hashes, weights)


def kinds(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, features: int, rounds: int = 20) -> np.ndarray:
    """The kind of each toxic row, -1 for the others: spherical k-means from the rows that lie farthest apart."""
    out, bad = np.full(len(toxic), -1), np.flatnonzero(toxic)
    x = np.zeros((len(bad), features), np.float32)
    place = np.full(len(toxic), -1)
    place[bad] = np.arange(len(bad))
    here = place[rows] >= 0
    x[place[rows[here]], cols[here]] = 1
    x /= np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))  # rows of ones and zeros: the root of the sum is the length
    centres = x[[int(x.sum(1).argmax())]] if len(bad) else x
    while 0 < len(centres) < min(KINDS, len(bad)):
        centres = np.concatenate((centres, x[[int((x @ centres.T).max(1).argmin())]]))
    for _ in range(rounds if len(bad) else 0):
        own = (x @ centres.T).argmax(1)
        out[bad] = own
        sums = np.array([x[own == k].sum(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(1e-12, np.linalg.norm(sums, axis=1, keepdims=True))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain from at most sample labelled rows; features are chosen by how much more often toxic rows have them."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in small(batches):
            texts = null_safe_texts(batch.column("text"))
            sets: list = [[]] * len(texts)
            for lo, bound, word, head in text_features(texts):
                for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist())):
                    sets[lo + i] = np.unique(np.concatenate((word[a:b], head[a:b]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "toxic", "hashes"])

    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most sample rows of two integers
    rows = cut(joined.mapInArrow(run, "doc_id long, toxic long, hashes array<long>").withColumn("toxic", F.expr("int(toxic <> 0)")))
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not total.n or not total.bad or total.bad == total.n:
        return Chain(np.empty(0, np.uint64), [])
    held = rows.select("toxic", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("rest")).where(f"bad >= {LEAST_TEXTS}")
    held = held.withColumn("lift", (F.col("bad") + 0.1) / (total.bad + 1) / ((F.col("rest") + 0.1) / (total.n - total.bad + 1))).where(f"lift >= {LEAST_LIFT}")
    chosen = held.orderBy((F.col("bad") * F.log("lift")).desc(), "hash").limit(FEATURES).select("hash").collect()  # at most FEATURES rows
    features = np.sort(np.array([r.hash for r in chosen], np.int64).astype(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def columns(batches):
        chain = Chain(shared.value, [])
        for batch in batches:
            cols = [chain.columns(np.array(h, np.int64).astype(np.uint64)) for h in batch.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([c[c >= 0].tolist() for c in cols], pa.list_(pa.int32()))], names=["doc_id", "toxic", "cols"])

    got = rows.mapInArrow(columns, "doc_id long, toxic int, cols array<int>").orderBy("doc_id", "toxic", F.hash("cols")).collect()  # the sample, FEATURES numbers a row at most
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % FOLDS for r in got])
    where = np.repeat(np.arange(len(got)), [len(r.cols) for r in got])
    cols = np.array([c for r in got for c in r.cols], np.int64)
    return Chain.learnt(features, where, cols, np.array([r.toxic for r in got], float), fold)


def judge(docs: DataFrame, chain: Chain) -> DataFrame:
    """All columns of docs with p_<category> and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((chain.hashes, chain.weights))
    names = [f"p_{c}" for c in CATEGORIES]
    kept = [c for c in docs.columns if c not in (*names, "toxic")]

    def run(batches):
        own = Chain(*shared.value)
        for batch in small(batches):
            p = own.probabilities(null_safe_texts(batch.column("text")))
            columns = [*(batch.column(c) for c in kept), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= REJECT_FROM)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names, "toxic"])

    schema = docs.select(kept).schema
    for name in names:
        schema = schema.add(name, "double")
    return docs.select(kept).mapInArrow(run, schema.add("toxic", "boolean"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
