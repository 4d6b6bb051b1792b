"""Set joins, near-duplicate vectors, packing and token files against plain versions."""

import itertools
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common, embedding_dedup, ngram_join, packing, pieces, token_files
from tidemark.llm.pieces import encoder

DOCS = "doc_id long, text string, lang string, n long"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, texts):
    """Documents with columns whose names clash with what the operators use inside."""
    return spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], DOCS).repartition(3)


def plain_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def plain_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def corpus(seed, groups=12, size=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "  \n", "one two", "One  TWO", "a b c", "É é É é É", "x " * 3000]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word()
            texts.append((passage + "\n" if rng.random() < 0.3 else "") + " ".join(copy))
    return texts


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80)])
def test_ngram_join_equals_all_pairs(spark, seed, n, percent):
    texts = corpus(seed)
    sets = plain_sets(texts, n)
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = {r.doc_id: r for r in ngram_join.NgramJoin(frame(spark, texts), n, percent).result().collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == list(map(len, sets))
    assert [got[i].component_id for i in range(len(texts))] == plain_components(len(texts), links)
    assert len(set(plain_components(len(texts), links))) < len(texts)


def test_ngram_join_of_a_group_at_the_threshold(spark):
    """Copies of one text, each with its own changes and some with shared ones: most pairs are just below or above the line."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(120)], []
    shared = [(rng.randrange(120), word()) for _ in range(6)]
    for i in range(220):
        copy = list(base)
        for at, w in rng.sample(shared, rng.randint(0, 4)):
            copy[at] = w
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    sets = plain_sets(texts, 4)
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    wanted = plain_components(len(texts), links)
    join = ngram_join.NgramJoin(frame(spark, texts))
    assert [r.component_id for r in sorted(join.result().collect())] == wanted
    assert 1 < len(set(wanted)) < 200


def test_groups_meet_only_where_enough_follows(spark):
    """A shingle that many sets of all sizes have: late in all prefixes it proposes nothing, and what it may propose stays."""
    p, rng = 85, random.Random(5)
    join = object.__new__(ngram_join.NgramJoin)
    join.percent = p
    schema = "token long, node long, n long, pos long, label long, root long"
    late = [(1, i, 100 + i % 8, ngram_join.prefix_length(100 + i % 8, p), i, i) for i in range(300)]
    found = spark.createDataFrame(late, schema)
    assert join.across(found).collect() == []
    assert join.meetings(found).count() < 1000  # by the sets' numbers alone 44,850
    sizes = [rng.randint(1, 60) for _ in range(80)]
    rows = [(token, i, n, pos + 1, i % 50, i % 60) for i, n in enumerate(sizes) for pos, token in enumerate(sorted(rng.sample(range(14), min(14, ngram_join.prefix_length(n, p)))))]
    wanted = set()
    for (i, x), (j, y) in itertools.combinations(enumerate(sizes), 2):
        if i % 60 == j % 60 or i % 50 == j % 50 or 100 * min(x, y) < p * max(x, y):
            continue
        need, most = -(-p * (x + y) // (100 + p)), max(-(-p * x // 100), -(-p * y // 100)) - 1
        ell = max(1, (need - most + 1) // 2)
        places = [(a[3], b[3]) for a in rows for b in rows if a[1] == i and b[1] == j and a[0] == b[0] and ell + min(x - a[3], y - b[3]) >= need]
        if places and len(places) >= ell and len(places) + min(x - max(a for a, _ in places), y - max(b for _, b in places)) >= need:
            wanted.add((i, j, x, y))
    got = join.across(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(wanted) > 20 and {tuple(r) for r in got} == wanted


def test_a_large_group_meets_only_groups_with_enough_in_common(spark):
    """One early shingle that a large group and many single sets have proposes nothing; a set with enough of them does."""
    join = object.__new__(ngram_join.NgramJoin)
    join.percent = 85
    schema = "token long, node long, n long, pos long, label long, root long"
    group = [(token, i, 145, token + 1, i, 0) for i in range(200) for token in range(9)]
    single = [(i % 9, 1000 + i, 145, 5, 1000 + i, 1000 + i) for i in range(300)]
    near = [(token, 5000, 145, token + 1, 5000, 5000) for token in range(12)]
    found = spark.createDataFrame(group + single + near, schema)
    assert {r.root_b for r in join.meetings(found).collect()} == {5000}  # 60,000 rows of nodes by the singles before
    assert sorted(tuple(r) for r in join.across(found).collect()) == [(i, 5000, 145, 145) for i in range(200)]


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_of_many_sizes_meet_as_their_sets_do(spark, percent):
    """Every pair of sets at the threshold from two groups is proposed, whatever sizes their groups have besides."""
    rng = random.Random(percent)
    sets, links = [], 0
    for _ in range(12):
        base = rng.sample(range(400), rng.randint(30, 130))
        for _ in range(9):
            sets.append(set(rng.sample(base, len(base) - rng.randint(0, len(base) // 9))) | set(rng.sample(range(400), rng.randint(0, len(base) // 9))))
    rows, root = [], [rng.randrange(30) for _ in sets]
    for i, s in enumerate(sets):
        for pos, token in enumerate(sorted(s)[: ngram_join.prefix_length(len(s), percent)]):
            rows.append((token, i, len(s), pos + 1, i, root[i]))
    join = object.__new__(ngram_join.NgramJoin)
    join.percent = percent
    got = {(r.a, r.b) for r in join.across(spark.createDataFrame(rows, "token long, node long, n long, pos long, label long, root long")).collect()}
    for a, b in itertools.combinations(range(len(sets)), 2):
        if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links += 1
            assert (a, b) in got
    assert links > 20


def test_a_set_of_many_copies_proposes_once(spark, monkeypatch):
    """Copies in many tasks, where the bitmap of wanted texts lets all through, as a full one does."""
    monkeypatch.setattr(ngram_join, "bitmap", lambda ids, bits: np.ones(1 << bits, bool))
    seen, across = [], ngram_join.NgramJoin.across
    monkeypatch.setattr(ngram_join.NgramJoin, "across", lambda self, rest: seen.extend(rest.select("token", "node").collect()) or across(self, rest))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 40 + [" ".join(words[:30] + [f"v{k}{i}" for i in range(30)]) for k in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = ngram_join.NgramJoin(docs).result().collect()
    assert len(seen) == len(set(seen)) > 0
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, 0 if i < 40 else i) for i in range(42)]


def test_ngram_join_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (3, b + " more"), (9, c), (9, c)]
    got = ngram_join.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string")).result().collect()
    assert sorted(map(tuple, got)) == [(3, 28, 3), (5, 27, 3), (5, 27, 3), (5, 27, 3), (9, 27, 9), (9, 27, 9)]


def test_ngram_join_of_nothing(spark):
    assert ngram_join.NgramJoin(frame(spark, []).limit(0)).result().collect() == []
    odd = spark.createDataFrame([(None, "a b c d"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.NgramJoin(odd).result().collect()] == [(1, 2, 1)] * 2


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 300: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [rng.normal(size=24) for _ in range(150)]
    rows += [rows[0] + 0.05 * rng.normal(size=24) for _ in range(700)]  # one bucket of several blocks
    rows += [r + 0.1 * rng.normal(size=24) for r in rows[:100]] + [rows[3], rows[3] * 7.0]
    lists = [[float(x) for x in r] for r in rows] + [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 5, [float("inf")] * 24]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= 0.9, 1)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(lists)], "vec_id long, embedding array<double>, t int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    links = np.array([got[i].n_links for i in range(len(lists))])
    wanted = np.concatenate((near.sum(0) + near.sum(1), np.zeros(7)))
    assert (links <= wanted).all()
    assert links.sum() >= 0.97 * wanted.sum()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all(got[i].component_id == i for i in range(len(rows), len(lists)))


@pytest.mark.parametrize("vectors,shift,bound", [(1_000_000, 0.0, 64), (60_000_000, 0.0, 200), (1_000_000, 0.6, 400)])
def test_tables_find_pairs_at_the_threshold(vectors, shift, bound):
    rng = np.random.default_rng(9)
    draw = lambda n: embedding_dedup.unit(rng.normal(size=(n, 64)) + shift)
    mean, planes, width = embedding_dedup.design(vectors, 64, 0.9, 0.97, draw(5000))
    a, b = embedding_dedup.threshold_pairs(draw(4000), 0.9, 4000, 1)
    assert np.allclose((a * b).sum(1), 0.9)
    meet = (embedding_dedup.keys_of(a, mean, planes, width) == embedding_dedup.keys_of(b, mean, planes, width)).any(1)
    assert meet.mean() >= 0.955
    assert planes.shape[1] // width <= bound


def test_vectors_of_each_length_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(size=12), rng.normal(size=7), rng.normal(size=12)
    rows = [(i, a) for i in range(20)] + [(30, b), (31, b * 2), (40, c), (40, a), (50, c), (51, np.zeros(12))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    forty = got[40]  # one of its two vectors counts
    assert (forty.n_links, forty.component_id) in ((20, 0), (1, 40))
    assert all(got[i].component_id == 0 and got[i].n_links == 19 + (forty.component_id == 0) for i in range(20))
    assert [(got[i].n_links, got[i].component_id) for i in (30, 31, 51)] == [(1, 30), (1, 30), (0, 51)]
    assert got[50].n_links == (forty.component_id == 40)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).collect() == []
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().kept


def test_release_returns_freed_memory(spark):
    resident = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) >> 10
    held = [np.ones(64 << 10, np.uint8) for _ in range(4000)]
    most, held = resident(), held[-1:]  # the last one keeps glibc from returning what lies before it
    common.release(spark)
    assert resident() < most - 150 and held[0].all()
    assert common.trim_jvm(spark).startswith("Trim native heap")


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_length_once(seed):
    rng = random.Random(seed)
    lengths = [min(4096, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(rng.choice([1, 40, 3000]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(histogram)
    held: dict[int, int] = {}
    for times, content in runs:
        assert 0 < sum(content) <= 4096
        for n in content:
            held[n] = held.get(n, 0) + times
    assert held == histogram
    assert sum(t for t, _ in runs) <= 1.05 * -(-sum(lengths) // 4096) + 2


def test_packing_documents(spark):
    texts = ["", None, "word " * 9000, "a b c", "a b c", *(f"text {i} " * (i * 7) for i in range(60))]
    got = packing.pack_documents(frame(spark, texts)).collect()
    encode = encoder("word_bpe_49k.json")
    by_doc: dict[int, list] = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.append(encode.whole(t or ""), 1).astype("<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 4096))
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in range(0, len(ids), 4096)]
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in rows:
            assert r.offset == end
            end += r.length
        assert end <= 4096
    assert packing.pack_documents(frame(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_library(name):
    rng = random.Random(4)
    bits = ["a", "b", "ab", "É", "é", "日本", "ß", "'s", "'ll", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "<|endoftext|>", "123", "　", "é", "́", "Σ", "İ", "\x1c", "\x85", "​", "\0", "K", "👍🏽"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    own = encoder(name)
    for text, ids in zip(texts, own(texts)):
        assert ids.tolist() == own.whole(text).tolist(), text


def test_columns_equal_the_library(monkeypatch):
    rng = random.Random(14)
    odd = [c.decode() for c in pieces.ODD_UTF8]
    bits = ["a", "b", "É", "日本", "ß", "'s", "'ll", " ", " ", " ", " ", "  ", "\n", "\n", ".", ",", "<|endoftext|>", "123", "é", "’", "—", "Σ", "\0", "👍🏽", *rng.sample(odd, 3)]
    texts = ["".join(rng.choice(bits[:24] if i % 3 else bits) for _ in range(rng.randint(0, 25))) for i in range(3000)] + [None, "", *(f"a{c}b" for c in odd), "a " * 30 + "b"]
    own = pieces.ColumnEncoder("byte_bpe_50k.json")
    monkeypatch.setattr(pieces, "GROUP", 50)
    for most in (1 << 27, 1 << 12):  # the second makes generations change places
        monkeypatch.setattr(pieces, "COLUMN_BYTES", most)
        for size in (1, 7, 100, 4000):
            for lo in range(0, len(texts), size):
                part = texts[lo : lo + size] if size > 1 else texts[lo // 20 : lo // 20 + 1]
                ids, counts = own(pa.array([None, *part], pa.string()).slice(1))
                assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own.library.whole(t or "").tolist() for t in part]
                own.trim()
    for nothing in ([], [None], ["", ""]):
        ids, counts = own(pa.array(nothing, pa.string()))
        assert len(ids) == 0 and counts.tolist() == [0] * len(nothing)


def test_a_piece_is_looked_up_once_a_batch(monkeypatch):
    rng, asked = random.Random(15), []
    words = ["".join(rng.choice("abcdeéß") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(1000)) for _ in range(50)]
    find = pieces.Known.find
    monkeypatch.setattr(pieces.Known, "find", lambda self, x: (asked.append(len(x)), find(self, x))[1])
    pieces.ColumnEncoder("byte_bpe_50k.json")(pa.array(texts))
    assert sum(asked) < 2000  # of 50,000 words; the encoder of lists looks up every one


def test_columns_of_words_equal_the_library(monkeypatch):
    rng = random.Random(16)
    bits = ["a", "B", "ab", "É", "e\u0301", "\u0301", "日本", "ß", "'", "'s", "'LL", "'re", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", ".", ",", "--", "|", "<|endoftext|>", "12", "3", "٣", "Σ", "İ", "K", "ſ", "\x00", "\x01", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\u200b", "’", "👍🏽"]
    texts = ["".join(rng.choice(bits if i % 3 else bits[:33]) for _ in range(rng.randint(0, 25))) for i in range(3000)] + [None, "", " ", "a " * 30 + "b", "\x01", "a\x01 b", *(f"a{c}b{c}'s" for c in bits)]
    own = pieces.ColumnEncoder("word_bpe_49k.json")
    monkeypatch.setattr(pieces, "GROUP", 60)
    for most in (1 << 27, 1 << 12):
        monkeypatch.setattr(pieces, "COLUMN_BYTES", most)
        for size in (1, 7, 4000):
            for lo in range(0, len(texts), size):
                part = texts[lo : lo + size] if size > 1 else texts[lo // 20 : lo // 20 + 1]
                ids, counts = own(pa.array([None, *part], pa.string()).slice(1))
                assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own.library.whole(t or "").tolist() for t in part]
                own.trim()
    for nothing in ([], [None], ["", " "]):
        ids, counts = own(pa.array(nothing, pa.string()))
        assert len(ids) == 0 and counts.tolist() == [0] * len(nothing)


def test_new_words_share_library_calls(monkeypatch):
    rng, asked = random.Random(17), []
    texts = [" ".join("".join(rng.choice("abcdeéß") for _ in range(6)) for _ in range(100)) for _ in range(50)]
    whole = pieces.Encoder.whole
    monkeypatch.setattr(pieces.Encoder, "whole", lambda self, x: (asked.append(x), whole(self, x))[1])
    pieces.ColumnEncoder("word_bpe_49k.json")(pa.array(texts))
    assert len(asked) < 20  # for 5,000 words


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(0, 50_256).astype(np.uint32)
    coder = token_files.Coder(*token_files.frequency_table(np.bincount(ids)))
    assert int(coder.f.sum()) == 1 << token_files.SCALE_BITS
    assert coder.decode(coder.encode(ids)).tolist() == ids.tolist()


def test_a_manifest_has_few_partitions(spark, tmp_path):
    docs = frame(spark, [f"text {i}" for i in range(50)])
    manifest = token_files.write_token_files(docs, str(tmp_path), "byte_bpe_50k.json", 0, 40)
    assert manifest.rdd.getNumPartitions() == 1  # each is a checkpoint file
    found = token_files.read_token_files(manifest, str(tmp_path)).collect()
    assert manifest.count() > 30 and sorted(r.doc_id for r in found) == list(range(50))


def test_packing_keeps_no_encoder_in_its_workers(spark):
    def held(_):
        from tidemark.llm import pieces

        yield "word_bpe_49k.json" in pieces._columns

    assert packing.pack_documents(frame(spark, ["a b c"] * 50)).count() == 50
    assert not any(spark.sparkContext.parallelize(range(8), 8).mapPartitions(held).collect())


def test_an_encoder_returns_memory_after_a_task(monkeypatch):
    own, calls = pieces.ColumnEncoder("byte_bpe_50k.json"), []
    monkeypatch.setattr(pieces, "trim_process", lambda: calls.append(len(own.young.places) + len(own.older.places)))
    monkeypatch.setattr(pieces, "COLUMN_BYTES", 1 << 12)
    for k in range(3):
        own(pa.array([f"a{k}b{i}" for i in range(100)]))
    own.trim()
    assert calls == [100]  # of two generations one is left then


@pytest.mark.parametrize("n", [1, 2047, 2048, 4096, 9000])
def test_blocks_side_by_side_equal_each_alone(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 50_256).astype(np.uint16)
    coder = token_files.Coder(*token_files.frequency_table(np.bincount(ids, minlength=1)))
    for size in (512, 1000, 2048):
        blocks = coder.encode_blocks(ids, size)
        assert blocks == [coder.encode(ids[lo : lo + size]) for lo in range(0, n, size)]
        for part in (blocks, blocks[: n // size], blocks[:1]):
            assert [x.tolist() for x in coder.decode_blocks(part)] == [ids[lo : lo + size].tolist() for lo in range(0, n, size)][: len(part)]


def test_blocks_decode_alone_and_damage_is_found(monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    ids = np.random.default_rng(1).integers(0, 300, 5500).astype(np.uint32)
    data = bytearray(token_files.encode_file(np.array([3, 5, 9]), np.array([100, 0, 5400]), ids))
    path = tmp_path / "x.rans"
    path.write_bytes(data)
    with path.open("rb") as handle:
        found = token_files.File(handle, len(data))
        assert found.block(3).tolist() == ids[3000:4000].tolist()
        assert [(d, i.tolist()) for d, i in found.documents()] == [(3, ids[:100].tolist()), (5, []), (9, ids[100:].tolist())]
    data[found.blocks[2][0] + 50] ^= 1
    path.write_bytes(data)
    with path.open("rb") as handle, pytest.raises(ValueError, match="block 2"):
        token_files.File(handle, len(data)).block(2)


def test_token_files(spark, tmp_path):
    texts = ["hello world", None, "", "É  x\n\ny", "word " * 2000]
    manifest = token_files.write_token_files(frame(spark, texts), f"file://{tmp_path}/ids", "byte_bpe_50k.json", 0, 3)
    got = sorted(token_files.read_token_files(manifest, f"file://{tmp_path}/ids").collect())
    start = 0
    for i, t in enumerate(texts):
        ids = np.append(encoder("byte_bpe_50k.json").whole(t or ""), 0).astype("<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    none = token_files.write_token_files(frame(spark, []).limit(0), f"file://{tmp_path}/none", "byte_bpe_50k.json", 0, 2)
    assert token_files.read_token_files(none, f"file://{tmp_path}/none").collect() == []
