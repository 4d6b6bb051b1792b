"""Language by bit-sliced Bloom filters of letter n-grams.

Training counts, per language, every letter n-gram's hash slot over all training texts (fixed-size count tables, summed
by slices). A slot belongs to a language where the n-gram is typical of it: frequent enough there and more so than a
share of its highest frequency in any language. The filter keeps a bit mask of languages per slot and hash function, in
as many 64-bit words as the languages need;
the AND over the hash functions names all languages that contain an n-gram. A text's hits are counted per language,
corrected for the filter's false positives, and the largest corrected share decides.

Edge cases: `und` with score 0 for a text that is null or has no letter, or if nothing was learnt; ties go to the
language first in alphabetical order; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, null_safe_texts, partitions_for, small, table

GRAM = 4
BITS = 18
HASHES = 2
#: An n-gram is typical of a language that has it at least this often per n-gram, and at this share of its top rate.
LEAST_RATE = 2e-6
SHARE = 0.35
CHUNK = 1 << 19
SLICE = 1 << 14

_letters: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Code point to lower-case letter; 32 stands for all that is no letter."""
    if "t" not in _letters:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                t[c] = ord(low) if len(low := chr(c).lower()) == 1 else c
        _letters["t"] = t
    return _letters["t"]


def gram_hashes(texts: list[str]):
    """Yields (first, last text, text numbers, 64-bit hashes) of the letter n-grams of texts, words edged by a space."""
    lo, table_ = 0, letter_table()
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK):
            size += len(texts[hi]) + 1
            hi += 1
        points = table_[np.frombuffer(" ".join(["", *texts[lo:hi], ""]).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(lo, hi), [len(t) + 1 for t in texts[lo:hi]])
        owner = np.append(owner, hi - 1)
        gap = points == 32
        keep = ~(gap & np.concatenate(([False], gap[:-1])))  # a run of other characters counts as one space
        points, owner = points[keep].astype(np.uint64), owner[keep]
        if len(points) > GRAM:
            h = np.zeros(len(points) - GRAM + 1, np.uint64)
            for k in range(GRAM):
                h = h * np.uint64(0x110001) + points[k : len(points) - GRAM + 1 + k]
            inner = owner[1 : 1 + len(h)]
            whole = (inner == owner[GRAM - 2 : GRAM - 2 + len(h)]) & (points[1 : 1 + len(h)] != 32) & (points[GRAM - 2 : GRAM - 2 + len(h)] != 32)
            yield lo, hi, inner[whole], mix64(h[whole])
        lo = hi


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """One slot for each hash function, from different bits of a hash."""
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(k * 64 // HASHES)) & mask).astype(np.int64) for k in range(HASHES)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Filters:
    """A mask of languages for each hash function and slot, and each language's false-positive rate."""

    def __init__(self, names: list[str], masks: np.ndarray):
        """masks: hash function, 64 languages, slot; the second may be left out for up to 64."""
        masks = masks[:, None] if masks.ndim == 2 else masks
        self.names, self.masks, self.bits = names, masks, int(np.log2(masks.shape[2])) if masks.size else 0
        fill = np.array([[(row[j // 64] >> np.uint64(j % 64) & np.uint64(1)).mean() for j in range(len(names))] for row in masks])
        self.false = fill.prod(0) if len(names) else np.empty(0)

    @classmethod
    def learnt(cls, names: list[str], counts: np.ndarray) -> Filters:
        """counts: language, hash function, slot."""
        rate = counts / np.maximum(1, counts.sum(2, keepdims=True))
        member = (rate >= LEAST_RATE) & (rate >= SHARE * rate.max(0, keepdims=True)) & (counts >= 2)
        masks = np.zeros((counts.shape[1], -(-len(names) // 64), counts.shape[2]), np.uint64)
        for j in range(len(names)):
            masks[:, j // 64] |= member[j].astype(np.uint64) << np.uint64(j % 64)
        return cls(names, masks)

    def contain(self, h: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits: one row for each 64 languages."""
        found = ~np.zeros((self.masks.shape[1], len(h)), np.uint64)
        for row, at in zip(self.masks, slots(h, self.bits)):
            found &= row[:, at]
        return found

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        hits, total = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for _, _, owner, h in gram_hashes(texts):
            found = self.contain(h)
            total += np.bincount(owner, minlength=len(texts))
            for j in range(len(self.names)):
                hits[:, j] += np.bincount(owner, weights=(found[j // 64] >> np.uint64(j % 64) & np.uint64(1)).astype(float), minlength=len(texts))
        share = np.clip((hits / np.maximum(total, 1)[:, None] - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1)
        best = share.argmax(1)
        score = share[np.arange(len(texts)), best] / np.maximum(share.sum(1), 1e-12)
        return [(self.names[b], float(min(1.0, s))) if has_letter(t) else ("und", 0.0) for t, b, s in zip(texts, best.tolist(), score.tolist())]


def learn(labelled: DataFrame, bits: int = BITS) -> Filters:
    """Filters from all rows of (lang, text). The count tables have a fixed size and travel by slices."""
    names = sorted(r.lang for r in labelled.select("lang").distinct().collect())  # one row a language
    if not names:
        return Filters([], np.zeros((HASHES, 0, 1 << bits), np.uint64))

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in small(batches):
            langs, texts = batch.column("lang").to_pylist(), null_safe_texts(batch.column("text"))
            for lang in sorted(set(langs)):
                own = counts.setdefault(lang, np.zeros((HASHES, 1 << bits), np.int64))
                for _, _, _, h in gram_hashes([t for t, x in zip(texts, langs) if x == lang]):
                    for row, at in zip(own, slots(h, bits)):
                        row += np.bincount(at, minlength=1 << bits)
        for lang, own in counts.items():
            flat = own.ravel()
            rows = [(k // SLICE, zlib.compress(flat[k : k + SLICE].tobytes(), 1)) for k in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(rows), "slice": pa.array([r[0] for r in rows], pa.int64()), "counts": [r[1] for r in rows]})

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key in zip(batch.column("lang").to_pylist(), batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(key[2]), np.int64)
                total[key[:2]] = total[key[:2]] + part if key[:2] in total else part
        if total:
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in total], "slice": pa.array([k[1] for k in total], pa.int64()), "counts": [zlib.compress(c.tobytes(), 1) for c in total.values()]})

    schema = "lang string, slice long, counts binary"
    parts = labelled.mapInArrow(count, schema).repartition(partitions_for(labelled.sparkSession), "lang", "slice").mapInArrow(add, schema)
    counts = np.zeros((len(names), HASHES << bits), np.int64)
    for r in parts.collect():  # languages x HASHES x 2**bits counts, whatever the input
        counts[names.index(r.lang), r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return Filters.learnt(names, counts.reshape(len(names), HASHES, 1 << bits))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.names, filters.masks))

    def run(batches):
        own = Filters(*shared.value)
        for batch in small(batches):
            found = own.judge(null_safe_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    filters = learn(docs.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"))
    return predict(docs, filters)
