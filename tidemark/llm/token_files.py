"""Token ids as entropy-coded binary files: static range asymmetric numeral system (rANS).

A file holds the documents of one doc_id range in ascending order. All its blocks share one quantised frequency
table; each block interleaves LANES independent 64-bit coder states over one stream of 32-bit words, and the footer
lists each block's offset, size, token count and crc32 (the checkpoints), so any block decodes alone and in parallel.

    magic | u32 header size | header (JSON) | table (zlib) | blocks | footer (zlib JSON and arrays) | u32 size | magic

A file holds about FILE_BYTES of text, so a task keeps a bounded number of ids (two bytes each) until the file's shared
table is known; only a single longer document makes a larger file.

Edge cases: a null or empty text is a document with the end id only; an empty table gives no files and no rows; rows
without doc_id are dropped, as they have no place in the order; rows that share a doc_id are each written, in the order of
their texts' crc32 and 64-bit hash.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh_dir, partitions_for, small, table
from tidemark.llm.pieces import GROUP, column_encoder

MAGIC = b"TMRANS1\n"
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 512
BLOCK = 1 << 17
FILE_BYTES = 16 << 20
#: Rows of the manifest in a partition.
MANIFEST_ROWS = 4096
#: Blocks that are coded side by side.
AHEAD = 8


def frequency_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, scaled to sum to 2**SCALE_BITS with none below 1."""
    symbols = np.flatnonzero(counts)
    c = counts[symbols].astype(np.float64)
    total = 1 << SCALE_BITS
    f = np.maximum(1, np.floor(c / c.sum() * total)).astype(np.int64)
    while (over := int(f.sum()) - total) > 0:
        order = np.argsort(-f, kind="stable")
        take = np.minimum(f[order] - 1, np.maximum(1, f[order] * over // max(1, int(f.sum()))))
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        f[order] -= take
    f[np.argmax(f)] -= min(over, 0)
    return symbols.astype(np.uint32), f.astype(np.uint32)


class Coder:
    """Block encoder and decoder for one frequency table."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.f = symbols, freqs.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(freqs)[:-1])).astype(np.uint64)
        self.slots = self.places = None

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        if self.places is None:
            self.places = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.uint32)
            self.places[self.symbols] = np.arange(len(self.symbols))
        return self.places[ids]

    def encode(self, ids: np.ndarray) -> bytes:
        """u32 token count, u32 lanes, final states, words in the order of decoding."""
        lanes = min(LANES, max(1, len(ids)))
        rows = -(-len(ids) // lanes)
        r = self.ranks(ids)
        x = np.full(lanes, LOW, np.uint64)
        out = []
        for row in range(rows - 1, -1, -1):
            now = r[row * lanes : (row + 1) * lanes]
            k = len(now)
            f, state = self.f[now], x[:k]
            spill = state >= f << np.uint64(63 - SCALE_BITS)
            if spill.any():
                out.append((state[spill] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                state = np.where(spill, state >> np.uint64(32), state)
            q = state // f
            x[:k] = (q << np.uint64(SCALE_BITS)) + (state - q * f) + self.cum[now]
        return struct.pack("<II", len(ids), lanes) + x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(out))

    def encode_blocks(self, ids: np.ndarray, size: int) -> list[bytes]:
        """encode() of each block of size ids; full blocks run side by side, so a step is one array operation for all."""
        full, lanes = len(ids) // size, min(LANES, size)
        if full < 2 or size % lanes:
            return [self.encode(ids[lo : lo + size]) for lo in range(0, len(ids), size)]
        r = self.ranks(ids[: full * size]).reshape(full, size)
        x, words, owners = np.full((full, lanes), LOW, np.uint64), [], []
        for lo in range(size - lanes, -1, -lanes):
            now = r[:, lo : lo + lanes]
            f = self.f[now]
            spill = np.flatnonzero(x >= f << np.uint64(63 - SCALE_BITS))
            if len(spill):
                state = x.ravel()
                words.append(state[spill].astype(np.uint32))
                owners.append((spill // lanes).astype(np.uint16 if full < 1 << 16 else np.int64))
                state[spill] >>= np.uint64(32)
            q = x // f
            x -= q * f
            q <<= np.uint64(SCALE_BITS)
            x += q
            x += self.cum[now]
        out = [struct.pack("<II", size, lanes) + row.astype("<u8").tobytes() for row in x]
        if words:
            words, owners = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
            words = words[np.argsort(owners, kind="stable")].astype("<u4")
            parts = np.split(words, np.cumsum(np.bincount(owners, minlength=full))[:-1])
            out = [head + part.tobytes() for head, part in zip(out, parts)]
        return out + ([self.encode(ids[full * size :])] if len(ids) > full * size else [])

    def decode(self, data: bytes) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        n, lanes = struct.unpack_from("<II", data)
        x = np.frombuffer(data, "<u8", lanes, 8).copy()
        words = np.frombuffer(data, "<u4", offset=8 + 8 * lanes).astype(np.uint64)
        ranks, at, mask = np.empty(n, np.uint32), 0, np.uint64((1 << SCALE_BITS) - 1)
        for lo in range(0, n, lanes):
            k = min(lanes, n - lo)
            state = x[:k]
            slot = state & mask
            s = self.slots[slot]
            ranks[lo : lo + k] = s
            state = self.f[s] * (state >> np.uint64(SCALE_BITS)) + slot - self.cum[s]
            need = np.flatnonzero(state < LOW)
            if len(need):
                state[need] = state[need] << np.uint64(32) | words[at : at + len(need)]
                at += len(need)
            x[:k] = state
        return self.symbols[ranks]


    def decode_blocks(self, blocks: list[bytes]) -> list[np.ndarray]:
        """decode() of each block; blocks of one size run side by side."""
        heads = {struct.unpack_from("<II", data) for data in blocks}
        n, lanes = min(heads, default=(0, 0))
        if len(blocks) < 2 or len(heads) > 1 or n % lanes:
            return [self.decode(data) for data in blocks]
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        x = np.stack([np.frombuffer(data, "<u8", lanes, 8) for data in blocks])
        words = [np.frombuffer(data, "<u4", offset=8 + 8 * lanes) for data in blocks]
        at = np.cumsum([0, *map(len, words)])[:-1]
        words, ranks, mask = np.concatenate(words), np.empty((len(blocks), n), np.uint32), np.uint64((1 << SCALE_BITS) - 1)
        for lo in range(0, n, lanes):
            slot = x & mask
            s = ranks[:, lo : lo + lanes] = self.slots[slot]
            x >>= np.uint64(SCALE_BITS)
            x *= self.f[s]
            x += slot
            x -= self.cum[s]
            need = np.flatnonzero(x < LOW)
            if len(need):
                owner, state = need // lanes, x.ravel()
                count = np.bincount(owner, minlength=len(blocks))
                state[need] = state[need] << np.uint64(32) | words[(at - np.cumsum(count) + count)[owner] + np.arange(len(need))]
                at += count
        return [self.symbols[row] for row in ranks]


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: all blocks share the frequency table of its ids."""
    parts = [ids[lo : lo + AHEAD * BLOCK] for lo in range(0, len(ids), AHEAD * BLOCK)]  # so what coding takes beside the ids is bounded
    counts = np.zeros(1 << 16, np.int64)
    for part in parts:
        counts += np.bincount(part, minlength=len(counts))
    symbols, freqs = frequency_table(counts)
    coder = Coder(symbols, freqs)
    shared = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freqs.astype("<u4").tobytes())
    head = json.dumps({"scale_bits": SCALE_BITS, "symbols": len(symbols), "table_bytes": len(shared), "table_crc32": zlib.crc32(shared)}).encode()
    out = [MAGIC, struct.pack("<I", len(head)), head, shared]
    at, blocks = sum(map(len, out)), []
    for lo, data in zip(range(0, len(ids), BLOCK), (data for part in parts for data in coder.encode_blocks(part, BLOCK))):
        blocks.append([at, len(data), min(BLOCK, len(ids) - lo), zlib.crc32(data)])
        out.append(data)
        at += len(data)
    docs = np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + lengths.astype("<u4").tobytes()
    index = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "blocks": blocks}).encode()
    foot = zlib.compress(struct.pack("<I", len(index)) + index + docs)
    return b"".join([*out, foot, struct.pack("<II", len(foot), zlib.crc32(foot)), MAGIC])


class File:
    """Reads a file by random access: the header and footer first, then any block alone."""

    def __init__(self, handle, size: int):
        self.handle = handle
        tail = self.read(size - 16, 16)
        if tail[8:] != MAGIC or self.read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        n, crc = struct.unpack("<II", tail[:8])
        foot = self.read(size - 16 - n, n)
        if zlib.crc32(foot) != crc:
            raise ValueError("footer checksum differs")
        foot = zlib.decompress(foot)
        (k,) = struct.unpack_from("<I", foot)
        index = json.loads(foot[4 : 4 + k])
        self.blocks, d = index["blocks"], index["docs"]
        self.doc_ids = np.cumsum(np.frombuffer(foot, "<i8", d, 4 + k))
        self.lengths = np.frombuffer(foot, "<u4", d, 4 + k + 8 * d).astype(np.int64)
        (k,) = struct.unpack("<I", self.read(8, 4))
        head = json.loads(self.read(12, k))
        shared = self.read(12 + k, head["table_bytes"])
        if zlib.crc32(shared) != head["table_crc32"]:
            raise ValueError("table checksum differs")
        shared = np.frombuffer(zlib.decompress(shared), "<u4")
        self.coder = Coder(np.cumsum(shared[: head["symbols"]]).astype(np.uint32), shared[head["symbols"] :])

    def read(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)

    def block(self, i: int) -> np.ndarray:
        return self.some(i, i + 1)[0]

    def some(self, first: int, end: int) -> list[np.ndarray]:
        """The ids of these blocks."""
        found = []
        for i, (at, size, _, crc) in enumerate(self.blocks[first:end], first):
            found.append(self.read(at, size))
            if zlib.crc32(found[-1]) != crc:
                raise ValueError(f"checksum of block {i} differs")
        out = self.coder.decode_blocks(found)
        for i, ids in enumerate(out, first):
            if len(ids) != self.blocks[i][2]:
                raise ValueError(f"block {i} has {len(ids)} ids, not {self.blocks[i][2]}")
        return out

    def documents(self):
        """(doc_id, ids as uint32) in file order, with at most a document and AHEAD blocks in memory."""
        have, ready, nxt = [], 0, 0
        for doc, n in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            while ready < n:
                # the last block is mostly shorter, so it is decoded alone
                end = min(nxt + AHEAD, max(nxt + 1, len(self.blocks) - 1))
                more = self.some(nxt, end)
                have += more
                ready += sum(map(len, more))
                nxt = end
            joined = np.concatenate(have) if len(have) > 1 else have[0] if have else np.empty(0, np.uint32)
            yield doc, joined[:n]
            have, ready = [joined[n:]], ready - n


def store(path: str):
    """A file system that reaches the path from any machine, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files_for(docs: DataFrame, size: int = FILE_BYTES) -> int:
    """How many files hold the texts at size bytes each, and no fewer than the tasks that can run at once."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(-(-total // size), docs.sparkSession.sparkContext.defaultParallelism)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, files: int) -> DataFrame:
    """Writes files of consecutive doc_id ranges below path; returns the manifest, one row per file.

    Texts are dealt by ranges of doc_id before they are encoded, so the range sampling reads no tokens. A file appears
    under its final name only when whole, and a repeated task writes the same bytes.
    """

    def write(batches):
        from pyspark import TaskContext

        encode, ids, doc_ids, lengths = column_encoder(vocabulary), [], [], []
        for batch in small(batches, 2 * GROUP):
            got, counts = encode(batch.column("text"))
            ids.append(np.insert(got, np.cumsum(counts), end_id))
            lengths.append(counts + 1)
            doc_ids.append(batch.column("doc_id").to_numpy())
        encode.trim()
        if not doc_ids:
            return
        part, doc_ids, lengths = TaskContext.get().partitionId(), np.concatenate(doc_ids), np.concatenate(lengths)
        data = encode_file(doc_ids, lengths, np.concatenate(ids))
        fs, folder = store(path)
        fs.create_dir(folder, recursive=True)
        tmp, name = f"{folder}/.part-{part:06d}-{TaskContext.get().taskAttemptId()}", f"part-{part:06d}.rans"
        with fs.open_output_stream(tmp) as out:
            out.write(data)
        fs.move(tmp, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(doc_ids)], "n_ids": [int(lengths.sum())], "bytes": [len(data)]})

    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit(""))), F.xxhash64("text"))
    manifest = rows.mapInArrow(write, "part long, file string, n_docs long, n_ids long, bytes long")
    # A checkpoint has a file for each partition, and for each file Hadoop starts a process, which the executor's memory counts for twice until it runs.
    return cut(manifest.repartition(-(-files // MANIFEST_ROWS)))


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, decoded from them."""

    def read(batches):
        fs, folder = store(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("file_start").to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as handle:
                    found = File(handle, handle.size())
                    rows = [(doc, len(ids), zlib.crc32(ids.astype("<u4", copy=False))) for doc, ids in found.documents()]
                doc, n, crc = (np.array(x, np.int64) for x in zip(*rows))
                yield pa.RecordBatch.from_pydict({"doc_id": doc, "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spread = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))
    spread = spread.repartition(partitions_for(manifest.sparkSession), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "ids")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, path, "byte_bpe_50k.json", 0, files_for(docs))
    return read_token_files(manifest, path)
