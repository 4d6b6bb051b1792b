"""Shared plumbing of the corpus operators: table access, reliable checkpoints, word hashing."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
POLY = 0x9E3779B97F4A7C15
POLY_INV = pow(POLY, -1, 1 << 64)
#: Powers that a worker keeps between calls.
KEEP_POWERS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints of plans that nothing refers to any more; the driver returns what it has freed to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_process()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str:
    """Returns memory outside the heap that the driver's JVM has freed; what the JVM says to it, empty where it has no such command."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    java = jvm.java.lang
    try:
        server, name = java.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = new(java.Object, 4)
        given[0], given[1], given[2], given[3] = name, "systemTrimNativeHeap", new(java.Object, 0), new(java.String, 0)
        # through the interface, as the server's own class is not open to py4j
        (invoke,) = (m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return str(invoke.invoke(server, given))
    except (Py4JError, ValueError):
        return ""


def trim_process() -> None:
    """Returns memory that this process has freed, which glibc keeps otherwise; elsewhere it does nothing."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, smaller than a checkpoint; give it to discard() after use."""
    path = fresh_dir(df.sparkSession, "stash")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(stashed: DataFrame) -> None:
    spark = stashed.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stashed.stashed_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, least: int = 0) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POLY**i and POLY**-i modulo 2**64 for i below n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        made = []
        for base in (POLY, POLY_INV):
            steps = np.full(1 << max(16, math.ceil(math.log2(n + 1))), base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > KEEP_POWERS:  # for one long text only
            return made[0][:n], made[1][:n]
        _powers["up"], _powers["down"] = made
    return _powers["up"][:n], _powers["down"][:n]


def words_of(raw: np.ndarray, lower: bool, head: int = 0) -> tuple[np.ndarray, ...]:
    """Start, end (bytes) and 64-bit hash of each word of UTF-8 bytes; lower folds A-Z only.

    With head also the hash of each word's first so many bytes, by another key.
    """
    gap = SPACE_BYTES[raw]
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return (start, end, *[np.empty(0, np.uint64)] * (2 if head else 1))
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    salted = lambda stop, salt: mix64((total[stop] - total[start]) * down[start] ^ ((stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt)))
    whole = salted(end, 0)
    return (start, end, whole, salted(np.minimum(end, start + head), 1)) if head else (start, end, whole)


def text_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def small(batches, limit: int = 2 << 20):
    """Slices of Arrow batches with at most limit bytes of text each, or one row, so what Python makes of one is bounded."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, limit + (size[lo - 1] if lo else 0), "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def null_safe_texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; TIDEMARK_TOKENIZERS overrides the installed folder."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, label), label the smallest node reachable.

    Alternates large-star and small-star steps on the edge list until it no longer changes. Each step is two
    aggregations and one equi join, so a hub with many edges is pre-aggregated and its join can be split by AQE.
    Nodes without edges are not returned; an empty edge list gives an empty table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e2 = large.where("u <> v")
        low = e2.groupBy("u").agg(F.min("v").alias("m"))
        small = e2.join(low, "u").select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        del both, low, large, e2, small
        release(e.sparkSession)
    found = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
