import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import packing, ppm, queries

from .conftest import SF, edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256)))


class Trie:
    """PPM method D with exclusion, symbol by symbol."""

    def __init__(self, order, texts):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            s = b"\xfe" * order + t + b"\xff"
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.seen[s[i - j : i]][s[i]] += 1

    def log(self, t):
        s, total = b"\xfe" * self.order + t + b"\xff", 0.0
        for i in range(self.order, len(s)):
            out = set()
            for j in range(self.order, -1, -1):
                here = {k: c for k, c in self.seen[s[i - j : i]].items() if k not in out} if s[i - j : i] in self.seen else {}
                if not here:
                    continue
                n = sum(here.values())
                if s[i] in here:
                    total += math.log10((2 * here[s[i]] - 1) / (2 * n))
                    break
                total += math.log10(len(here) / (2 * n))
                out |= set(here)
            else:
                total -= math.log10(256 - len(out))
        return total


def check_scores(found, rows, order):
    train = [lower(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 and i is not None]
    trie, counts = Trie(order, train), Counter()
    for t in train:
        counts.update(WORD.findall(t.decode()))
        counts["\n end"] += 1
    n, v = sum(counts.values()), len(counts)
    by = defaultdict(list)
    for i, t in rows:
        by[i].append(lower(t))
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append(r)
    assert got.keys() == by.keys()
    for i, some in by.items():
        expected = sorted((round(trie.log(t), 6), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*WORD.findall(t.decode()), "\n end"]), 6)) for t in some)
        assert [x for r in sorted((r.score, r.base_score) for r in got[i]) for x in r] == pytest.approx([x for e in expected for x in e], abs=1e-5)
        for r in got[i]:
            assert r.train_tokens == n
        known = sorted((len(WORD.findall(t.decode())) + 1, sum(counts[w] > 0 for w in [*WORD.findall(t.decode()), "\n end"])) for t in some)
        assert sorted((r.n_tokens, r.n_known) for r in got[i]) == known


def learn():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


def test_scores_match_a_trie(edge):
    rows = [(i, t) for i, t in edge_texts()]
    for size in (48 << 20, 5000):  # one group and many
        check_scores(ppm.score_documents(edge, learn(), order=3, group_bytes=size).collect(), rows, 3)
    for order in (3, 5):  # nearly all contexts of two bytes are split
        check_scores(ppm.score_documents(edge, learn(), order=order, least_split=2).collect(), rows, order)


def test_query_on_a_table(spark, texts):
    found = queries.op1_ppm_score(spark, SF).collect()
    some = dict(list(texts.items())[:25])
    train = [lower(t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    trie = Trie(5, [t for t in train])
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        if r.doc_id in some:
            assert r.score == pytest.approx(trie.log(lower(texts[r.doc_id])), abs=1e-4)
    assert len(found) == len(texts)


def test_scoring_nothing(empty, edge):
    assert ppm.score_documents(empty, F.lit(True)).collect() == []
    r = ppm.score_documents(edge.where("doc_id = 4"), F.lit(False)).first()
    assert r.score == pytest.approx(-4 * math.log10(256)) and r.n_known == 0 and r.train_tokens == 0


def check_pieces(rows, expected):
    """Every document's ids lie in its pieces once each, and sequences have no gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert docs.keys() == expected.keys()
    for i, found in docs.items():
        want = sorted(expected[i])
        assert sum(r.length for r in found) == sum(len(w) for w in want)
        if len(want) == 1:
            at = 0
            for r in sorted(found, key=lambda r: r.start):
                ids = np.array(want[0][r.start : r.start + r.length], "<u4")
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[0])
                at += r.length
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096 and len({r.window for r in found}) == 1
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def ids_of(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_tokenizer())
    out = defaultdict(list)
    for i, text in rows:
        out[i].append(t.encode(text or "", add_special_tokens=False).ids + [2])
    return out


def test_packing_edges(edge, empty):
    check_pieces(packing.pack(edge, queries.word_tokenizer()).collect(), ids_of(edge_texts()))
    assert packing.pack(empty, queries.word_tokenizer()).collect() == []


def test_packing_a_table(spark, texts):
    expected = ids_of(texts.items())
    padding = check_pieces(queries.op6_packing(spark, SF).collect(), expected)
    assert padding <= 4096


def test_leftovers_of_many_partitions(documents, texts):
    rows = packing.pack(documents.repartition(40), queries.word_tokenizer(), merge=16).collect()
    assert check_pieces(rows, ids_of(texts.items())) < 0.15 * sum(r.length for r in rows)


def test_packer_by_brute_force():
    """Windows are full, every token is in one piece, tiers hold what they are for, and most documents stay whole."""
    r = np.random.default_rng(3)
    for held in (1 << 18, 20_000, 0):
        lengths = np.r_[r.integers(1, 4097, 400), r.integers(1, 300, 900), r.integers(4097, 30_000, 6)]
        r.shuffle(lengths)
        packer = packing.Packer(held_tokens=held)
        for i, n in enumerate(lengths.tolist()):
            packer.add(i, n)
        # what opens a window belongs to its tier, and what fills its gap to shorter ones
        for window, taken in packer.full:
            assert window == 128 or taken[0][2] > window // 2 and all(2 * n <= window for _, _, n in taken[1:])
        rest = packer.close()
        covered, pieces = defaultdict(list), Counter()
        for window, taken in [*packer.full, (0, rest)]:
            assert window == 0 or sum(n for _, _, n in taken) == window and window & (window - 1) == 0
            for i, start, n in taken:
                covered[i].append((start, n))
                pieces[i] += 1
        assert sum(n for _, _, n in rest) < 128
        for i, n in enumerate(lengths.tolist()):
            at = 0
            for start, length in sorted(covered[i]):
                assert start == at
                at += length
            assert at == n
        if held == 1 << 18:
            whole = sum(pieces[i] == 1 for i, n in enumerate(lengths) if n <= 4096)
            assert whole > 0.85 * sum(lengths <= 4096)


def test_gaps_are_filled_exactly_where_they_can_be():
    r = np.random.default_rng(5)
    for _ in range(200):
        packer = packing.Packer(longest=64, shortest=8)
        lengths = r.integers(1, 40, 12).tolist()
        for i, n in enumerate(lengths):
            packer.put((i, 0, n))
        gap = int(r.integers(1, 64))
        some = packer.two(gap)
        assert bool(some) == (gap in lengths or any(a + b == gap for i, a in enumerate(lengths) for b in lengths[:i]))
        assert not some or sum(some) == gap and not Counter(some) - Counter(lengths)
        some = packer.three(gap)
        assert not some or sum(some) == gap and not Counter(some) - Counter(lengths)


def test_step_groups_are_balanced(documents, texts):
    for parts in (1, 7):
        rows = packing.pack(documents.repartition(parts), queries.word_tokenizer(), step_groups=5).collect()
        window = {r.sequence_id: (r.window, r.step_group) for r in rows}
        sums = Counter()
        for w, g in window.values():
            sums[g] += w
        assert max(sums.values()) - min(sums.get(g, 0) for g in range(5)) <= 4096


def test_other_tokenizers(edge):
    """A vocabulary that joins over white space gets whole texts."""
    from tokenizers import Tokenizer

    path = queries.word_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    t, out = Tokenizer.from_file(path), defaultdict(list)
    for i, text in edge_texts():
        out[i].append(t.encode(text or "", add_special_tokens=False).ids + [2])
    assert not packing.WordEncoder(path).by_word and packing.WordEncoder(queries.word_tokenizer()).by_word
    check_pieces(packing.pack(edge, path).collect(), out)


def test_joined_words():
    e = packing.WordEncoder(queries.word_tokenizer())
    texts = ["a\x1cb c\x1f", "x\x85y z\u00a0w\u2003v\x0b\x0cq", "...", "a.b, C!? don't", "İstanbul ıI straße ΣΑΣ", "가각 abc 각", "a b c", "ﬁne ŉ words"]
    assert e(texts) == e.whole(texts)
