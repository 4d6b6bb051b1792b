"""SentencePiece N-best segmentation over the piece lattice, and decoding.

The lattice of a text has an edge for every piece of the model that matches at a position, scored as in the model, and one
byte-fallback edge for a character without a piece. Forward Viterbi gives each position its exact best score from the
start; a backward A-star search from the end uses these as heuristic, so paths come out best first.

No piece holds a space mark after another character, or a line feed, so the lattice has a cut before each mark that
follows no mark and around each line feed: a run of marks and its word are one segment, and the N best of a text are the
N best sums over its segments. The model gives the bare mark and its runs of marks a score of -1e9 each, and so does the lattice. Only the N - 1 segments whose second-best path loses least can differ
from their best path in the N best of the text (each of them alone already gives one as good), so A-star runs on those.

Normalisation: a space mark before the text, a mark for each space, nothing else. Edge cases: a null or empty text has no
pieces, one segmentation and score 0; ties are broken by the ids within a segment, then by its place; a literal mark decodes to a space, as in
the model itself; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import null_safe_texts, small, table, tokenizer_path

MARK = "▁"
N_BEST = 4
FALLBACK = 10.0
#: Scores this low (runs of marks) do not count for the score of the byte fallback.
LOW = -1e8
MAX_SEGMENTS = 600_000
#: Longer segments, and those with a character without a piece, are searched one by one.
WIDE = 24
#: Texts whose new segments are learnt together.
GROUP = 500
RUN = re.compile(f"{MARK}+[^{MARK}]*")
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Leading bits of a hash that name a bucket of pieces.
BUCKET_BITS = 20


class Lattice:
    """The pieces of a model and the searches over them."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=tokenizer_path(name))
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in usable}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a mark after another character")
        self.fallback = min(s for _, s in self.pieces.values() if s > LOW) - FALLBACK
        self.longest = max(map(len, self.pieces))
        self.starts = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.plain = np.frombuffer(b"".join(plain.get(i, b"") for i in range(size)), np.uint8)
        self.plain_end = np.cumsum([len(plain.get(i, b"")) for i in range(size)])
        self.plain_count = np.array([len(plain[i]) if i in plain else -1 for i in range(size)])
        self.keys, self.key_ids, self.key_scores = self.hashed()
        self.cuts = not any("\n" in p for p in self.pieces)
        self.cache: dict[str, int] = {}
        self.options: dict[tuple[int, int], list] = {}
        self.texts: list[str] = []
        self.ids: list[bytes] = []
        self.score, self.loss = np.zeros(1 << 12), np.zeros(1 << 12)

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces by the ascending hash of their characters: hashes, ids, scores; for find() also where each bucket begins."""
        found = []
        for piece, (i, score) in self.pieces.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = h * PRIME + np.uint64(ord(c) + 1)
            found.append((int((h * PRIME)[0]), i, score))
        found.sort()
        if len({h for h, _, _ in found}) < len(found):
            raise ValueError("two pieces share a hash")
        h, i, score = zip(*found)
        h = np.array(h, np.uint64)
        self.buckets = np.searchsorted(h, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        self.fullest = int(np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)).max())
        return h, np.array(i, np.int64), np.array(score)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or of another key: the first of its bucket that isn't below it."""
        at = self.buckets[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        last = np.int32(len(self.keys) - 1)
        np.minimum(at, last, out=at)
        for _ in range(self.fullest - 1):
            at += self.keys[at] < h
            np.minimum(at, last, out=at)
        return at

    def segments(self, text: str) -> list[str]:
        """The text between the lattice's cuts: before each run of marks and, as no piece holds a line feed, around those."""
        parts = RUN.findall(MARK + text.replace(" ", MARK))
        if not self.cuts or "\n" not in text:
            return parts
        return [q for p in parts for q in (re.split("(\n)", p) if "\n" in p else (p,)) if q]

    def learn(self, segments: list[str]) -> None:
        """Enters new segments: Viterbi over all segments of one length at a time."""
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s), []).append(s)
        for n, group in by_length.items():
            if n > WIDE:
                for s in group:
                    self.number(s)
                continue
            for lo in range(0, len(group), 1 << 15):
                self.learn_equal(group[lo : lo + (1 << 15)], n)

    def learn_equal(self, group: list[str], n: int) -> None:
        m = len(group)
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n).T.astype(np.uint64) + np.uint64(1)
        best, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        piece, length = np.zeros((n + 1, m), np.int64), np.ones((n + 1, m), np.int64)
        best[0], plain = 0.0, np.ones(m, bool)
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for k in range(1, min(self.longest, n - i) + 1):
                h = h * PRIME + codes[i + k - 1]
                key = h * PRIME
                at = self.find(key)
                hit = self.keys[at] == key
                if k == 1:
                    plain &= hit
                rows = np.flatnonzero(hit)
                if not len(rows):
                    continue
                at, end = at[rows], i + k
                s1, s2, old = best[i, rows] + self.key_scores[at], second[i, rows] + self.key_scores[at], best[end, rows]
                up = s1 > old
                second[end, rows] = np.where(up, np.maximum(old, s2), np.maximum(second[end, rows], s1))
                best[end, rows] = np.where(up, s1, old)
                piece[end, rows[up]], length[end, rows[up]] = self.key_ids[at[up]], k
        ids, at, count, every = np.zeros((n, m), np.int64), np.full(m, n), np.zeros(m, np.int64), np.arange(m)
        for step in range(n - 1, -1, -1):
            on = at > 0
            ids[step] = np.where(on, piece[at, every], 0)
            at, count = at - np.where(on, length[at, every], 0), count + on
        raw, k = ids.T.astype("<u2").tobytes(), len(self.ids)
        for j in np.flatnonzero(~plain).tolist():
            self.number(group[j])
        some = np.flatnonzero(plain)
        k = len(self.ids)
        while len(self.score) < k + len(some):
            self.score, self.loss = (np.concatenate((x, np.zeros(len(x)))) for x in (self.score, self.loss))
        self.score[k : k + len(some)] = best[n, some]
        self.loss[k : k + len(some)] = best[n, some] - second[n, some]
        for place, (j, c) in enumerate(zip(some.tolist(), count[some].tolist()), k):
            self.cache[group[j]] = place
            self.texts.append(group[j])
            self.ids.append(raw[2 * (n * (j + 1) - c) : 2 * n * (j + 1)])
        for place in (k + np.flatnonzero(self.loss[k : k + len(some)] == 0)).tolist():
            self.ids[place] = np.array(self.n_best(self.texts[place], 1)[0][1], "<u2").tobytes()

    def edges(self, text: str, start: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(end, score, ids) of the edges that leave a position."""
        found, get = [], self.starts.get
        for end in range(start + 1, len(text) + 1):
            piece = get(text[start:end], 0)
            if piece == 0:
                break
            if piece is not None:
                found.append((end, piece[1], (piece[0],)))
        if not found or found[0][0] != start + 1:
            raw = text[start].encode("utf-8", "surrogatepass")
            found.append((start + 1, self.fallback * len(raw), tuple(self.bytes[b] for b in raw)))
        return found

    def forward(self, text: str) -> tuple[list[list], list[float]]:
        """Edges by their end, and the best score from the start to each position."""
        n, low = len(text), float("-inf")
        into: list[list] = [[] for _ in range(n + 1)]
        best = [0.0] + [low] * n
        for i in range(n):
            for end, s, ids in self.edges(text, i):
                into[end].append((i, s, ids))
                best[end] = max(best[end], best[i] + s)
        return into, best

    def best_two(self, text: str) -> tuple[list[int], float, float]:
        """Ids and score of the best path and the score of the second best, by forward Viterbi."""
        n, low, get = len(text), float("-inf"), self.starts.get
        best, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b1, b2, single = best[i], second[i], False
            for end in range(i + 1, n + 1):
                piece = get(text[i:end], 0)
                if piece is None:
                    continue
                if piece == 0:
                    break
                if end == i + 1:
                    single = True
                s = b1 + piece[1]
                if s > best[end]:
                    s2 = b2 + piece[1]
                    second[end] = best[end] if best[end] > s2 else s2
                    best[end], back[end] = s, (i, piece[0])
                elif s > second[end]:
                    second[end] = s
            if not single:
                raw, end = text[i].encode("utf-8", "surrogatepass"), i + 1
                s = b1 + self.fallback * len(raw)
                if s > best[end]:
                    second[end] = max(best[end], b2 + self.fallback * len(raw))
                    best[end], back[end] = s, (i, raw)
                elif s > second[end]:
                    second[end] = s
        ids, at = [], n
        while at:
            at, own = back[at]
            ids += [self.bytes[b] for b in reversed(own)] if isinstance(own, bytes) else [own]
        return ids[::-1], best[n], second[n]

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one segment, by backward A-star with the forward scores as heuristic."""
        into, best = self.forward(text)
        # Equal scores go by the place from the end, then by the ids, which piece and rank of the rest order alike; a
        # place's first n rests are enough for the n best.
        heap: list = [(-best[len(text)], -len(text), (), 0, 0.0, None)]
        seen = [0] * (len(text) + 1)
        out: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(out) < n:
            _, at, own, _, done, rest = heapq.heappop(heap)
            rank = seen[-at]
            if rank == n:
                continue
            seen[-at] += 1
            node = (own, rest)
            if at == 0:
                ids: list[int] = []
                while node:
                    ids += node[0]
                    node = node[1]
                out.append((done, tuple(ids)))
                continue
            for start, s, own in into[-at]:
                heapq.heappush(heap, (-(best[start] + s + done), -start, own, rank, done + s, node))
        return out

    def number(self, segment: str) -> int:
        """Place of a segment in the tables, which it enters when first seen."""
        ids, best, second = self.best_two(segment)
        if best == second:
            ids = self.n_best(segment, 1)[0][1]
        k = len(self.ids)
        if k == len(self.score):
            self.score, self.loss = (np.concatenate((x, np.zeros(len(x)))) for x in (self.score, self.loss))
        self.cache[segment] = k
        self.texts.append(segment)
        self.ids.append(np.array(ids, "<u2").tobytes())
        self.score[k], self.loss[k] = best, best - second
        return k

    def encode_all(self, texts: list[str], n: int = N_BEST):
        """encode() for each text; the new segments of GROUP texts are learnt together."""
        for lo in range(0, len(texts), GROUP):
            if len(self.ids) > MAX_SEGMENTS:
                self.cache.clear()
                self.options.clear()
                self.texts.clear()
                self.ids.clear()
            group = [self.segments(t) if t else [] for t in texts[lo : lo + GROUP]]
            have, flat, at = self.cache, [s for segments in group for s in segments], 0
            places = list(map(have.get, flat))
            missing = [i for i, p in enumerate(places) if p is None]
            self.learn(list(dict.fromkeys([flat[i] for i in missing])))
            for i in missing:
                places[i] = have[flat[i]]
            for text, segments in zip(texts[lo : lo + GROUP], group):
                yield self.encode(text, n, places[at : at + len(segments)])
                at += len(segments)

    def encode(self, text: str, n: int = N_BEST, places: list[int] | None = None) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a text as (score, ids), best first."""
        if not text:
            return [(0.0, np.empty(0, np.uint16))]
        get, number = self.cache.get, self.number
        places = places or [p if (p := get(s)) is not None else number(s) for s in self.segments(text)]
        parts, at = [self.ids[p] for p in places], np.array(places)
        total, loss = float(self.score[at].sum()), self.loss[at]
        if n == 1:
            return [(total, np.frombuffer(b"".join(parts), np.uint16))]
        k = min(n - 1, len(loss))
        line = np.partition(loss, k - 1)[k - 1]
        near = np.concatenate((np.flatnonzero(loss < line), np.flatnonzero(loss == line)[:k]))
        near = near[np.isfinite(loss[near])]
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for i in near.tolist():
            options = self.options.get((places[i], n))
            if options is None:
                own = self.n_best(self.texts[places[i]], n)
                options = self.options[places[i], n] = [(s - own[0][0], ids) for s, ids in own]
            sums = heapq.nsmallest(n, ((x - d, (*c, (i, ids))) for x, c in sums for d, ids in options), key=lambda x: x[0])
        out = []
        for x, changes in sums:
            now = parts
            if changes:
                now = parts.copy()
                for i, ids in changes:
                    now[i] = np.array(ids, "<u2").tobytes()
            out.append((total - x, np.frombuffer(b"".join(now), np.uint16)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation."""
        count = self.plain_count[ids]
        at = np.repeat(self.plain_end[ids] - np.cumsum(count), count)
        at += np.arange(len(at))
        return self.plain[at].tobytes().decode("utf-8", "surrogatepass")[1:]


_lattices: dict[str, Lattice] = {}


def lattice(name: str) -> Lattice:
    if name not in _lattices:
        _lattices[name] = Lattice(name)
    return _lattices[name]


def encode_n_best(docs: DataFrame, n: int = N_BEST, name: str = "piece_bpe_32k.model", with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces and ids_crc32 of the best segmentation, scores and crc32s of the n best, and whether all decode to the text."""
    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, crc32s array<long>, round_trip boolean" + (", ids array<array<int>>" if with_ids else "")

    def run(batches):
        own = lattice(name)
        for batch in small(batches):
            rows = []
            texts = null_safe_texts(batch.column("text"))
            for text, found in zip(texts, own.encode_all(texts, n)):
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found]
                whole = text.replace(MARK, " ")
                back = all((own.decode(ids) if len(ids) else "") == whole for _, ids in (found[0], found[-1]))
                rows.append((len(found[0][1]), crcs[0], [s for s, _ in found], crcs, back, *([[ids.tolist() for _, ids in found]] if with_ids else [])))
            if rows:
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.list_(pa.int32()))]
                names = ["doc_id", "n_pieces", "ids_crc32", "scores", "crc32s", "round_trip", "ids"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=names[: len(cols) + 1])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>)."""

    def run(batches):
        own = lattice(name)
        for batch in batches:
            texts = [own.decode(np.array(ids, np.uint16)) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_n_best(table(spark, sf_dir, "documents"))
