import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm import minhash, queries, sharding

from .conftest import SF, edge_texts, rows_of, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).decode())
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}, sets


def check(found, rows, width):
    comp, sets = brute(rows, width)
    assert sorted((str(r.doc_id), r.n_shingles) for r in found) == sorted((str(i), len(s)) for i, s in sets)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == comp[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_edges(edge, empty):
    check(minhash.near_duplicates(edge, width=2).collect(), edge_texts(), 2)
    assert minhash.near_duplicates(empty).collect() == []
    kept = minhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert all(n == 1 for i, n in ids.items() if i is not None) and ids[None] == 2


@pytest.mark.parametrize("width", [2, 5])
def test_a_table(spark, documents, texts, width):
    found = minhash.near_duplicates(documents, width=width) if width == 5 else queries.op4_minhash_dedup(spark, SF)
    check(found.collect(), list(texts.items()), width)


def test_a_group_of_near_copies(spark):
    """Copies of one text with up to 25 % of their words changed, in blocks of few members."""
    r = np.random.default_rng(1)
    base = [f"v{i}" for i in r.integers(0, 4000, 150)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in r.choice(150, r.integers(0, 38), replace=False):
            words[at] = f"v{r.integers(0, 4000)}"
        rows.append((1000 - i, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows_of(rows), SCHEMA), width=2, block=16).collect()
    check(found, rows, 2)


def test_estimates_follow_similarity():
    r = np.random.default_rng(2)
    sets = []
    for share in (0.9, 0.6, 0.3):
        a = r.integers(0, 2**63, 2000).astype(np.uint64)
        b = a.copy()
        n = int(2000 * (1 - share) / (1 + share))
        b[:n] = r.integers(0, 2**63, n)
        sets += [np.unique(a), np.unique(b)]
    v = minhash.minima(sets, 512)
    for bits in (1, 2, 4, 8):
        sig = minhash.packed_bits(v, bits)
        for k in range(0, 6, 2):
            true = len(np.intersect1d(sets[k], sets[k + 1])) / len(np.union1d(sets[k], sets[k + 1]))
            assert abs(float(minhash.similarity(sig[k], sig[k + 1], 512, bits)) - true) < 0.16


def test_bitmaps_bound_differences():
    r = np.random.default_rng(4)
    for n in (1, 5, 40, 700):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], r.integers(0, 2**63, 2 * n).astype(np.uint64)])
        x, y = (np.frombuffer(minhash.bitmap(s), np.uint8)[None] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        differ = int(np.bitwise_count(minhash.folded(x, width) ^ minhash.folded(y, width)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (n < 5 or differ > 0.5 * len(np.setxor1d(a, b)))


def check_shards(found, rows, shards=24):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    return [sizes[s] for s in range(shards)]


def test_shards(edge, empty, spark, documents):
    check_shards(sharding.vector_shards(edge).collect(), edge_texts())
    assert sharding.vector_shards(empty).collect() == []
    found = queries.op8_vector_shards(spark, "/root/testdata/sf0.01").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sizes = check_shards(found, rows)
    largest = max(r.size for r in found)
    assert max(sizes) - min(sizes) <= max(largest, 0.02 * sum(sizes))


def test_a_hot_group_is_split(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(6000)]
    sizes = check_shards(sharding.vector_shards(spark.createDataFrame(rows_of(rows), SCHEMA), slice_rows=2000).collect(), rows)
    assert max(sizes) <= 1.02 * min(sizes)


def test_placing():
    v = np.array([[6.0, 1, 1], [1, 6, 1], [1, 1, 6]] * 8)
    found = sharding.place(v / v.sum(0), np.full((3, 3), 1 / 3))
    loads = np.array([v[found == s].sum(0) for s in range(3)])
    spread = loads.max(0) - loads.min(0)
    assert spread[0] <= v[0].sum() and (spread <= 2 * v[0].sum()).all()  # one vector in the law's dimension, two in the others


def test_placing_by_brute_force():
    """The same shards as the rule in plain steps."""
    r = np.random.default_rng(8)
    for turn in range(20):
        shards, n = int(r.integers(1, 9)), int(r.integers(0, 60))
        v = r.pareto(1.5, (n, 3)) + 0.01
        v = v / max(1e-9, v.sum()) if n else v
        given = r.random((shards, 3)) / shards
        room = [list(x) for x in given]
        want = {}
        for i in sorted(range(n), key=lambda i: -max(v[i])):
            order = [(s + turn) % shards for s in range(shards)]
            good = [s for s in order if all(a >= b for a, b in zip(room[s], v[i]))] or [s for s in order if room[s][0] >= v[i][0]] or order
            best = max(good, key=lambda s: (float(np.dot(room[s], v[i])), -order.index(s)))
            want[i] = best
            room[best] = [a - b for a, b in zip(room[best], v[i])]
        assert sharding.place(v, given, turn).tolist() == [want[i] for i in range(n)]


def test_groups_stay_whole(spark):
    """Only groups above a shard's share are split, at one level and at several."""
    r = np.random.default_rng(6)
    sizes = [400, 200, 90, 40, 12, 5, 2, 2, 2]
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"{i} " + "y" * int(r.integers(0, 400)) for i in range(3000)] + ["hot"] * 1500
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    for shards, slice_rows in ((8, 10**6), (8, 300), (4, 50)):
        found = sharding.vector_shards(docs, shards, slice_rows).collect()
        loads = check_shards(found, rows, shards)
        assert max(loads) <= 1.05 * min(loads)
        where = defaultdict(set)
        for x in found:
            where[texts[x.doc_id]].add(x.shard)
        count = Counter(texts)
        total = sum(len(t) + 8 for t in texts)
        for t, some in where.items():
            small = count[t] <= len(texts) / shards and count[t] * (len(t) + 8) <= total / shards
            assert len(some) == 1 or not small and count[t] * 2 > len(texts) / shards
        assert len(where["hot"]) > shards // 2  # split, over the shards that have room


def test_repeated_ids_with_different_texts(spark):
    words = lambda k, n=60: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(5, words("a")), (5, words("b")), (6, words("a") + " more"), (7, words("b") + " more"), (2, words("c")), (1, words("c")), (1, words("d")), (3, words("d")), (9, words("e"))]
    rows += [(8, words("f"))] * 300 + [(10, words("f") + " more")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, width=2).collect()}
    assert found == {(5, 5), (6, 5), (7, 5), (1, 1), (2, 1), (3, 1), (9, 9), (8, 8), (10, 8)}
    assert minhash.near_duplicates(docs, width=2).count() == len(rows)


def test_sets_of_an_id_join_transitively(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words("a")), (2, words("b")), (4, words("a")), (4, words("b")), (3, words("b") + " more")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, width=2).collect()} == {(1, 1), (2, 1), (4, 1), (3, 1)}
