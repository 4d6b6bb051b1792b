"""N-gram Jaccard self-join by vertical partitioning.

A document is its set of distinct n-word shingles. All shingles have one global order: by the document-frequency class
of a fixed-size count sketch (so shingles that many documents share come last), then by hash. The order is cut into
fragments; a document's set is cut with it, and whatever is counted of two sets is counted in every fragment apart and
summed per pair. The first fragments, as far as a set's prefix reaches, also propose the pairs.

1. Texts with equal sets are one node, named by a 64-bit hash of the set.
2. By the prefix principle two sets with a Jaccard similarity of t share one of their (1 - t) n + 1 first shingles. In a
   first round each prefix shingle proposes only (its smallest node, each other one): stars, so a group of thousands of
   near copies makes no list of pairs. Proposed pairs are counted by fragment; links give components.
3. Only nodes with a prefix shingle that two components share can still have a link that matters. They are dealt into
   groups: a node follows the smaller node that it shares most prefix shingles with (a quarter at least), up to a root. Within a group sets
   are replaced by their differences from the root's set, taken by fragment. Symmetric differences of sets are those of
   the differences, so two sets link only where these share half as much as they exceed the bound by; what most of a
   group has falls out, and the rarest differences propose the pairs by the prefix and position bounds. Features that one
   component alone has count as unshared. A pair too close for any difference to be shared is linked through the root.
   A group of RECENTRE or more first takes the member nearest to what most members have as its root, which joins most of
   what there is to join at once.
4. Pairs from different groups share a prefix shingle; groups meet in it first, by classes of size, under the place
   bounds of the sizes that hold it, and in as many shingles as the least of their pairs must share. Only the nodes of
   groups that are left meet, so a large group is not dealt out to each set that shares a shingle or two with it.

No link between different components is lost, and links within a component found before are not looked for: links() is
a connecting subset of all links. Hashes have 58 bits or more: a collision may change an intersection by one.

Edge cases: texts that are null, empty or without words have an empty set and link with nothing; texts with fewer words
than n have one shingle; rows without doc_id are dropped; rows that repeat a doc_id count as one document whose rows reach
each other, each with its own set size. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, discard, mix64, release, small, stash, table, words_of

N = 4
PERCENT = 85
FRAGMENTS = 5
CHUNK = 1 << 18
#: Groups from this size on look for a better root.
RECENTRE = 8
#: The ratio of neighbouring classes of size.
CLASS = 1.05
#: Texts that are turned into sets at a time.
GROUP = 1000
SLICE = 1 << 16
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)


def shingle_sets(texts: list[str | None], n: int):
    """Yields (index, sorted distinct 64-bit shingle hashes) of each text; A-Z are folded."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) < CHUNK):
            size += len(raw[hi])
            hi += 1
        begin = np.cumsum([0, *(len(r) + 1 for r in raw[lo:hi])])
        start, _, word = words_of(np.frombuffer(b" ".join(raw[lo:hi]), np.uint8), True)
        bound = np.searchsorted(start, begin)
        h = np.full(max(0, len(word) - n + 1), n, np.uint64)
        for k in range(n):
            h += word[k : len(word) - n + 1 + k] * WEIGHTS[k]
        h = mix64(h)
        for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist())):
            if b - a >= n:
                yield lo + i, np.unique(h[a : b - n + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64) + (word[a:b] * WEIGHTS[: b - a]).sum(dtype=np.uint64)
                yield lo + i, mix64(short)
            else:
                yield lo + i, np.empty(0, np.uint64)
        lo = hi


class Sketch:
    """Counts of hashes by their leading bits, in slices that travel apart and are summed by slice."""

    def __init__(self, bits: int):
        self.bits, self.counts, self.waiting, self.size = bits, np.zeros(1 << bits, np.int32), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append((hashes >> np.uint64(64 - self.bits)).astype(np.int32))
        self.size += len(hashes)
        if self.size > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=len(self.counts)).astype(np.int32)
            self.waiting, self.size = [], 0

    def slices(self):
        self.flush()
        for k in range(0, len(self.counts), SLICE):
            part = self.counts[k : k + SLICE]
            if part.any():
                yield k // SLICE, zlib.compress(part.astype(np.uint32).tobytes(), 1)


def merge_slices(rows: DataFrame, bits: int) -> np.ndarray:
    """Sums slices on the executors; the driver gets one byte a bucket: twice the binary logarithm of its count."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(data), np.uint32)
                total[k] = total[k] + part if k in total else part.astype(np.int64)
        if total:
            codes = [np.where(c > 0, 1 + np.floor(2 * np.log2(np.maximum(c, 1))), 0).astype(np.uint8).tobytes() for c in total.values()]
            yield pa.RecordBatch.from_pydict({"slice": list(total), "codes": codes})

    out = np.zeros(1 << bits, np.uint8)
    for r in rows.repartition(min(1 << bits - 16, 64), "slice").mapInArrow(add, "slice long, codes binary").collect():  # 2**bits bytes in all
        out[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.codes, np.uint8)
    return out


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A fixed-size bitmap of a long column's hashes; when it fills up it only lets more through."""

    def mark(batches):
        sketch = Sketch(bits)
        for batch in batches:
            sketch.add(mix64(batch.column(0).to_numpy().astype(np.uint64)))
        rows = list(sketch.slices())
        if rows:
            yield pa.RecordBatch.from_pydict({"slice": [k for k, _ in rows], "counts": [c for _, c in rows]})

    return merge_slices(ids.mapInArrow(mark, "slice long, counts binary"), bits) > 0


def order_keys(hashes: np.ndarray, codes: np.ndarray, bits: int, usual: int) -> np.ndarray:
    """The global order as ascending integers: frequency class above the usual one, then hash."""
    heavy = np.maximum(0, codes[(hashes >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64) - usual)
    return (np.minimum(heavy, 31).astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch_bits(docs: DataFrame) -> int:
    """Buckets in proportion to the input's bytes, within 2**18 and 2**24."""
    size = float(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(24, max(18, math.ceil(math.log2(max(size, 1) / 256)))))


def set_name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


class NgramJoin:
    """Set sizes, connecting links and components of the documents' shingle sets at percent or more."""

    def __init__(self, docs: DataFrame, n: int = N, percent: int = PERCENT, fragments: int = FRAGMENTS):
        self.docs, self.n, self.percent, self.fragments = docs.select("doc_id", "text").where("doc_id IS NOT NULL"), n, percent, fragments
        self.spark, self.bits = docs.sparkSession, sketch_bits(docs)
        self.scanned = cut(self.scan())
        self.sizes = self.scanned.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "node")
        codes = merge_slices(self.scanned.where("slice IS NOT NULL").select("slice", "counts"), self.bits)
        usual = int(np.percentile(codes[codes > 0], 75)) + 1 if codes.any() else 1
        self.order = self.spark.sparkContext.broadcast((codes, usual))
        self.nodes = cut(self.sizes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")))

    def scan(self) -> DataFrame:
        n, bits = self.n, self.bits

        def run(batches):
            sketch = Sketch(bits)
            for batch in small(batches):
                size, node = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
                for at in range(0, batch.num_rows, GROUP):
                    for i, s in shingle_sets(batch.column("text").slice(at, GROUP).to_pylist(), n):
                        if len(s):
                            size[at + i], node[at + i] = len(s), set_name(s)
                            sketch.add(s)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(node), pa.nulls(len(size), pa.int64()), pa.nulls(len(size), pa.binary())], names=names)
            rows = list(sketch.slices())
            k = len(rows)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(3)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=names)

        names = ["doc_id", "n_shingles", "node", "slice", "counts"]
        return self.docs.mapInArrow(run, "doc_id long, n_shingles long, node long, slice long, counts binary")

    def ordered_sets(self, wanted: DataFrame, make, schema: str) -> DataFrame:
        """make((node, sorted keys)) -> batches, over one text of each wanted node; a few others may come with them."""
        n, bits, order = self.n, self.bits, self.order
        wanted = self.spark.sparkContext.broadcast(bitmap(wanted.join(self.nodes, "node").select("rep"), max(20, self.bits)))

        def run(batches):
            codes, usual = order.value
            here, seen = wanted.value, set()
            shift = np.uint64(64 - int(math.log2(len(here))))

            def fresh(texts):
                for _, s in shingle_sets(texts, n):
                    if len(s) and (node := set_name(s)) not in seen:
                        seen.add(node)
                        yield node, order_keys(s, codes, bits, usual)

            for batch in small(batches):
                keep = np.flatnonzero(here[(mix64(batch.column("doc_id").to_numpy().astype(np.uint64)) >> shift).astype(np.int64)])
                for lo in range(0, len(keep), GROUP):
                    yield from make(fresh(batch.column("text").take(pa.array(keep[lo : lo + GROUP])).to_pylist()))

        return self.docs.mapInArrow(run, schema)

    def prefixes(self) -> DataFrame:
        """(token, node, n, pos): the first keys of every node's set and their places, from 1."""
        percent = self.percent

        def make(sets):
            tokens, nodes, sizes = [], [], []
            for node, keys in sets:
                p = prefix_length(len(keys), percent)
                tokens.append(np.sort(np.partition(keys, p - 1)[:p]))
                nodes.append(node)
                sizes.append(len(keys))
            if tokens:
                p = [len(t) for t in tokens]
                yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens).astype(np.int64), "node": np.repeat(np.array(nodes, np.int64), p), "n": np.repeat(np.array(sizes, np.int64), p), "pos": np.concatenate([np.arange(1, k + 1) for k in p])})

        return self.ordered_sets(self.nodes.select("node"), make, "token long, node long, n long, pos long")

    def cut_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, fragment, keys): the sets of the wanted nodes, cut at fixed pivots of the global order."""
        pivots = np.array([(k << 58) // (self.fragments - 1) for k in range(1, self.fragments)], np.int64)  # the last one holds the frequent classes

        def make(sets):
            nodes, frag, keys = [], [], []
            for node, s in sets:
                s = np.sort(s).astype(np.int64)
                for k, part in enumerate(np.split(s, np.searchsorted(s, pivots))):
                    if len(part):
                        nodes.append(node)
                        frag.append(k)
                        keys.append(part)
            if nodes:
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "fragment": pa.array(frag, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})

        return stash(self.ordered_sets(wanted, make, "node long, fragment long, keys array<long>"))

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, na, nb) that link: overlaps counted by fragment, then summed by pair."""
        left = sets.select(F.col("node").alias("a"), "fragment", F.col("keys").alias("ka"))
        right = sets.select(F.col("node").alias("b"), "fragment", F.col("keys").alias("kb"))
        partial = pairs.join(right, "b").join(left, ["a", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ka", "kb")).alias("part"))
        parts = [F.coalesce(F.max(F.when(F.col("fragment") == k, F.col("part"))), F.lit(0)) for k in range(self.fragments)]  # a set may come more than once
        total = partial.groupBy("a", "b", "na", "nb").agg(sum(parts[1:], parts[0]).alias("overlap"))
        found = cut(total.where(f"100 * overlap >= {self.percent} * (na + nb - overlap)").select("a", "b"))
        del left, right, partial, total
        release(self.spark)
        return found

    def stars(self, shared: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) of a shingle's smallest node with the others, where enough prefix shingles meet."""
        met = shared.where("a <> node").groupBy("a", F.col("node").alias("b"), F.col("n").alias("nb")).agg(F.count("*").alias("both"))
        found = met.join(self.nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
        return cut(found.where(self.near("na", "nb")).where(self.enough()).select("a", "b", "na", "nb"))

    def near(self, na: str, nb: str) -> str:
        return f"100 * least({na}, {nb}) >= {self.percent} * greatest({na}, {nb})"

    def enough(self) -> str:
        """Of two sets, the one whose prefix ends first shares with the other what both prefixes share and what follows its own."""
        p = self.percent
        rest = lambda n: f"({p} * {n} + 99) div 100 - 1"
        return f"both >= ({p} * (na + nb) + {99 + p}) div {100 + p} - greatest({rest('na')}, {rest('nb')})"

    def roots(self, shared: DataFrame) -> DataFrame:
        """(node, root): each node follows the smaller one that it shares most prefix shingles with, a quarter at least."""
        met = shared.where("a <> node").groupBy("node", "n", "a").agg(F.count("*").alias("both"))
        best = met.groupBy("node", "n").agg(F.max(F.struct("both", "a")).alias("best"))
        hubs = best.where(f"4 * best.both >= n - ({self.percent} * n + 99) div 100 + 1").select(F.col("node").alias("a"), F.col("best.a").alias("b"))
        return components(hubs).withColumnRenamed("label", "root")

    def bounds(self):
        """SQL of: what two sizes' sets must share; how many shingles in common have a place that leaves the rest behind
        them, half of what prefixes can show; and whether a place leaves enough for the least size of class k, which
        decides for the class as what must follow grows with the size."""
        p = self.percent
        need, rest_of = lambda x, y: f"(({p} * ({x} + {y}) + {99 + p}) div {100 + p})", lambda n: f"({p} * {n} + 99) div 100 - 1"
        ell = lambda x, y: f"greatest(1, ({need(x, y)} - greatest({rest_of(x)}, {rest_of(y)}) + 1) div 2)"
        least = lambda n, k: f"greatest(({p} * {n} + 99) div 100, cast(floor(power({CLASS}D, {k})) as bigint))"
        return need, ell, lambda n, pos, k: f"{need(n, least(n, k))} - {ell(n, least(n, k))} <= {n} - {pos}"

    def place(self, a: str, b: str, room: str) -> str:
        """Whether sizes a and b, or the least of a group's, may link by a shingle with so many behind it; it only gets harder for larger ones."""
        need, ell, _ = self.bounds()
        lift = lambda x, y: f"greatest({x}, ({self.percent} * {y} + 99) div 100)"
        x, y = lift(a, b), lift(b, a)
        return f"{need(x, y)} - {ell(x, y)} <= {room}"

    def meetings(self, rest: DataFrame) -> DataFrame:
        """(token, class_a, class_b, root_a, root_b, lo_b, room_b): groups with nodes of two classes of size that a shingle may propose.

        Whether a place leaves enough behind it depends on both sizes, so a shingle that many sets have late in their
        prefixes proposes none of them. Two groups whose smallest and largest sizes ask for more shingles than they meet
        in have no pair.
        """
        p, (_, _, early) = self.percent, self.bounds()
        apart = math.ceil(math.log(100 / p) / math.log(CLASS))
        held = self.classed(rest).select("token", "root", "class", "n", "pos", F.expr(f"explode(sequence(class - {apart}, class + {apart}))").alias("other"))
        held = held.where(early("n", "pos", "other")).groupBy("token", "root", "class", "other").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("room"))
        own = lambda x: (F.col(c).alias(f"{c}_{x}") for c in ("root", "lo", "hi", "room"))
        low = held.where("other >= class").select("token", F.col("class").alias("class_a"), F.col("other").alias("class_b"), *own("a"))
        high = held.where("other <= class").select("token", F.col("other").alias("class_a"), F.col("class").alias("class_b"), *own("b"))
        met = low.join(high, ["token", "class_a", "class_b"]).where("root_a < root_b OR class_a < class_b AND root_a <> root_b")
        met = cut(met.where(self.place("lo_a", "lo_b", "least(room_a, room_b)")))
        keys = ["root_a", "class_a", "root_b", "class_b"]
        both = met.groupBy(*keys).agg(F.count("*").alias("both"), *(F.min(f"lo_{x}").alias(f"lo_{x}") for x in "ab"), *(F.max(f"hi_{x}").alias(f"hi_{x}") for x in "ab"))
        # In 100 (100 + p) parts: what sizes lo and hi must share exceeds what follows the larger one's prefix by.
        over = lambda lo, hi: f"100 * {p} * ({lo} + {hi}) - {p} * {100 + p} * {hi}"
        both = both.where(f"both >= (greatest(0, least({over('lo_a', 'hi_b')}, {over('lo_b', 'hi_a')})) div {100 * (100 + p)} + 2) div 2")
        return met.join(both.select(*keys), keys).select("token", *keys, "lo_b", "room_b")

    def classed(self, rest: DataFrame) -> DataFrame:
        return rest.withColumn("class", F.expr(f"cast(floor(ln(n) / ln({CLASS}D)) as int)"))

    def across(self, rest: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) from different groups that share a prefix shingle."""
        need, ell, _ = self.bounds()
        one, two = (self.classed(rest).select("token", F.col("root").alias(f"root_{x}"), F.col("class").alias(f"class_{x}"), F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "pos", "label"))) for x in "ab")
        pairs = self.meetings(rest).join(one, ["token", "root_a", "class_a"]).where(self.place("n_a", "lo_b", "least(n_a - pos_a, room_b)"))
        pairs = pairs.join(two, ["token", "root_b", "class_b"]).where("label_a <> label_b").where(self.near("n_a", "n_b"))
        need, ell = need("n_a", "n_b"), ell("n_a", "n_b")
        pairs = pairs.where(f"{ell} + least(n_a - pos_a, n_b - pos_b) >= {need}")
        last = F.least(F.col("n_a") - F.max("pos_a"), F.col("n_b") - F.max("pos_b"))
        pairs = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("both"), last.alias("last")).where(f"both >= {ell} AND both + last >= {need}")
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, n_a, n_b)").alias("na"), F.expr("if(a < b, n_b, n_a)").alias("nb"))

    def differences(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(node, root, label, n, added, missing, diff) by fragment: what a set has and its group's root's set has not, and the reverse."""
        spread = members.groupBy("root").agg((F.count("*") / 512 + 1).cast("int").alias("copies"))
        own = sets.groupBy("node", "fragment").agg(F.first("keys").alias("keys"))
        every = members.join(spread, "root").withColumn("salt", F.pmod(F.xxhash64("node"), "copies")).withColumn("fragment", F.explode(F.expr(f"sequence(0L, {self.fragments - 1}L)")))
        of_root = own.withColumnRenamed("node", "root").join(spread, "root").select("root", "fragment", F.col("keys").alias("root_keys"), F.explode(F.expr("sequence(0L, copies - 1L)")).alias("salt"))
        both = every.join(own, ["node", "fragment"], "left").join(of_root, ["root", "fragment", "salt"], "left")
        none = F.expr("cast(array() as array<bigint>)")
        a, b = F.coalesce("keys", none), F.coalesce("root_keys", none)
        both = both.withColumn("plus", F.array_except(a, b)).withColumn("minus", F.array_except(b, a))
        found = stash(both.select("node", "root", "label", "n", F.size("plus").alias("added"), F.size("minus").alias("missing"), F.concat("plus", "minus").alias("diff")))
        del own, every, of_root, both
        release(self.spark)
        return found

    def recentred(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Members of large groups with the member as root whose set differs least from the shingles that most members have."""
        large = members.groupBy("root").agg(F.count("*").alias("size")).where(f"size >= {RECENTRE}")
        of = found.select("node", "root", F.explode("diff").alias("token"))
        usual = of.groupBy("root", "token").agg(F.count("*").alias("held")).join(large, "root").where("2 * held > size").select("root", "token")
        usual = of.join(usual, ["root", "token"]).groupBy("node", "root").agg(F.count("*").alias("usual"))
        size = found.join(large, "root").groupBy("node", "root").agg(F.sum(F.col("added") + F.col("missing")).alias("s"))
        off = size.join(usual, ["node", "root"], "left").withColumn("off", F.col("s") - 2 * F.coalesce("usual", F.lit(0)))
        centre = off.groupBy("root").agg(F.min(F.struct("off", "node")).alias("centre"))
        return cut(members.join(centre, "root").select("node", "n", "label", F.col("centre.node").alias("root")))

    def within(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) with roots, and pairs (a, b, na, nb) from one group, by the differences from its root."""
        p = self.percent
        whole = found.groupBy("node", "root", "label", "n").agg(F.sum("added").alias("added"), F.sum("missing").alias("missing"))
        rooted = whole.where(f"node <> root AND 100 * (n - added) >= {p} * (n + missing)").select(F.col("root").alias("a"), F.col("node").alias("b"))
        rooted = cut(rooted)
        joined = whole.join(rooted.select(F.col("a").alias("root"), F.col("b").alias("node")), ["root", "node"]).select("root", "label")
        joined = joined.union(whole.where("node = root").select("root", "label")).distinct().withColumn("joined", F.lit(True))
        whole = cut(whole.join(joined, ["root", "label"], "left").withColumn("label", F.expr("if(joined, root, label)")).drop("joined"))
        of = found.select("node", "root", F.explode("diff").alias("token")).join(whole.select("node", "label"), "node")
        mixed = of.groupBy("root", "token").agg(F.count("*").alias("held"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("root", "token", "held")
        ranked = of.join(mixed, ["root", "token"]).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("held", "token")))
        ranked = ranked.withColumn("shared", F.count("*").over(Window.partitionBy("node")))
        size = whole.select("node", "n", (F.col("added") + F.col("missing")).alias("s"))
        first = ranked.join(size, "node").withColumn("pos", F.expr("s - shared + rank")).where(f"pos <= 1 + {100 - p} * n div {p}")
        first = stash(first.select("root", "token", "node", "label", "n", "s", "pos"))
        one, two = (first.select("root", "token", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("label", "n", "s", "pos"))) for x in "ab")
        pairs = one.join(two, ["root", "token"]).where("a < b AND label_a <> label_b").where(self.near("n_a", "n_b"))
        pairs = pairs.where(f"2 * (1 + least(s_a - pos_a, s_b - pos_b)) >= s_a + s_b - {100 - p} * (n_a + n_b) div {100 + p}")
        pairs = pairs.where(f"abs(s_a - s_b) <= {100 - p} * (n_a + n_b) div {100 + p}")
        last = F.least(F.col("s_a") - F.max("pos_a"), F.col("s_b") - F.max("pos_b"))
        pairs = pairs.groupBy("a", "b", "n_a", "n_b", "s_a", "s_b").agg((F.count("*") + last).alias("most")).where(f"2 * most >= s_a + s_b - {100 - p} * (n_a + n_b) div {100 + p}")
        pairs = cut(pairs.select("a", "b", F.col("n_a").alias("na"), F.col("n_b").alias("nb")))
        discard(first)
        return rooted, pairs

    def links(self) -> DataFrame:
        """Links (a, b) between nodes; they connect all that any links connect."""
        tokens = self.prefixes()
        first = tokens.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").drop("top")
        shared = stash(tokens.join(first, "token").repartition("token", "node").distinct())  # a set may come more than once
        del tokens, first
        release(self.spark)
        proposed = self.stars(shared)
        sets = self.cut_sets(self.ends(proposed))
        links = self.linked(proposed, sets)
        discard(sets)
        label, root = cut(components(links)), cut(self.roots(shared))
        release(self.spark)
        named = shared.select("token", "node", "n", "pos").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
        rest = stash(named.join(mixed, "token").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
        del named, mixed
        discard(shared)
        release(self.spark)
        known = proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        far = cut(self.across(rest).join(known, ["a", "b"], "left_anti"))
        members = rest.select("node", "n", "label", "root").distinct()
        split = members.groupBy("root").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("root")
        members = cut(members.join(split, "root"))
        discard(rest)
        release(self.spark)
        sets = self.cut_sets(self.ends(far).union(members.select("node")).union(members.select("root")).distinct())
        found = self.differences(members, sets)
        moved = self.recentred(members, found)
        release(self.spark)
        again = self.differences(moved, sets)
        rooted, close = self.within(found.join(moved.select("node"), "node", "left_anti").unionByName(again))
        discard(found)
        discard(again)
        release(self.spark)
        more = self.linked(far.unionByName(close.join(known, ["a", "b"], "left_anti")), sets)
        discard(sets)
        return links.union(rooted).union(more)

    def ends(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        held = self.sizes.where("n_shingles > 0")
        repeated = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").drop("top")
        same = held.join(repeated, "doc_id").select("a", F.col("node").alias("b"))
        nodes = cut(self.nodes.join(components(self.links().union(same)), "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label")))
        least = nodes.groupBy("label").agg(F.min("rep").alias("found"))
        named = nodes.join(least, "label").select("node", "copies", "found")
        # At most 4096 nodes can each have more than a 4096th of all rows; the rows of any other node fit one task.
        most = self.sizes.count() // 4096 + 1
        hot, other = F.broadcast(named.where(F.col("copies") > most).drop("copies")), named.where(F.col("copies") <= most).drop("copies")
        out = self.sizes.join(hot, "node").unionByName(self.sizes.join(hot, "node", "left_anti").join(other, "node", "left"), allowMissingColumns=True)
        return out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(table(spark, sf_dir, "documents")).result()
