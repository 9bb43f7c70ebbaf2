"""Byte-level BPE and alignment against the libraries themselves and plain steps."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import alignment, bpe, queries

from .conftest import SF

P = pytest.importorskip("public_tokenizers")
RANKS, JSON, MODEL = (P.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ALPHABET = ["a", "b", "aa", "-", "--", "=", "  ", " ", "\n", "\n\n", "é", "你", "😀", "'s", "'S", "1", "12", "\xa0", "\x85", " e", "t", " th", "the", "_", "*", "\x1c", "\x00", "　", "▁", "<|endoftext|>", "<0x0A>", "ß", "я"]


def strings(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET if i % 3 else ALPHABET[:9], k=r.randrange(0, 40))) + r.choice(ALPHABET) * r.choice([0, 0, 1, 30]) for i in range(n)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_ids_equal_the_library(library):
    book, texts = bpe.opened(RANKS, P.PATTERN), strings(4000)
    for most in (1, len(texts)):  # texts alone and side by side
        for i in range(0, len(texts), most):
            ids, counts = book.encode([t.encode() for t in texts[i : i + most]])
            for t, own in zip(texts[i : i + most], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert own.tolist() == library.encode_ordinary(t), t
    assert book.encode([]) [0].size == 0 and book.encode([b"", b""])[1].tolist() == [0, 0]


def test_bpe_query(spark, texts, library):
    found = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_bpe_edges_and_offsets(spark, edge, empty, library):
    rows = bpe.decode(bpe.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    given = Counter((r.doc_id, (r.text or "").encode()) for r in edge.collect())
    assert Counter((r.doc_id, bytes(r.decoded)) for r in rows) == given
    more = spark.createDataFrame(list(enumerate(strings(300, 9))), "doc_id long, text string")
    texts = dict(enumerate(strings(300, 9)))
    for r in bpe.encode(more, RANKS, P.PATTERN).collect():
        t, data, split = texts[r.doc_id], texts[r.doc_id].encode(), 0
        assert r.ids == library.encode_ordinary(t)
        char_of = [i for i, c in enumerate(t) for _ in c.encode()]
        for i, x, y, c, d in zip(r.ids, r.byte_starts, r.byte_ends, r.char_starts, r.char_ends, strict=True):
            assert data[x:y] == library.decode_single_token_bytes(i) and (c, d) == (char_of[x], char_of[y - 1] + 1)
            split += t[c:d].encode() != data[x:y]
        assert r.n_split == split
    assert bpe.encode(empty, RANKS, P.PATTERN).collect() == [] and bpe.decode(bpe.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).collect() == []


def test_decoding_of_parts_and_unknown_ids(spark, library):
    book = bpe.opened(RANKS, P.PATTERN)
    ids = library.encode_ordinary("x 😀你͸ y")
    parts = list(book.texts(ids))
    assert "".join(parts) == "x 😀你͸ y" and "" in parts
    assert "".join(book.texts(ids[:2])) == "x �"
    rows = spark.createDataFrame([(1, [ids[0], None, 50256, -1, 10**6]), (2, None), (3, [])], "doc_id int, ids array<int>").withColumn("decoded", F.lit("clash"))
    found = {r.doc_id: (bytes(r.decoded), r.n_unknown) for r in bpe.decode(rows, RANKS, P.PATTERN).collect()}
    assert found == {1: (b"x", 3), 2: (b"", 0), 3: (b"", 0)}


def plain_alignment(texts):
    """Digest columns of each text by loops over byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    byte = {c: x for x, c in enumerate(bpe.byte_characters())}
    docs, held = [], Counter()
    for t in texts:
        tokens_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)] if t else []
        if not t or not (b"".join(x for _, x in tokens_a) == b"".join(x for _, x in tokens_b) == (" " + t).encode()):
            docs.append(None)
            continue
        spans = []
        for tokens in (tokens_a, tokens_b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        both = sorted({z for _, _, z in spans[0]} & {z for _, _, z in spans[1]})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(i) for i, x, y in side if low <= x and y <= high) for side in spans))
            low = high
        links, first = [], 0
        for i, x, y in spans[0]:
            while spans[1][first][2] <= x:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < y:
                links.append((i, spans[1][k][0]))
                k += 1
        held.update(set(links))
        docs.append((len(tokens_a), len(tokens_b), groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha(";".join(groups).encode())))
    return out


def digest(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_alignment_query(spark, texts):
    found = {r.doc_id: digest(r) for r in queries.op11_token_alignment(spark, SF).collect()}
    assert found == dict(zip(texts, plain_alignment([t or "" for t in texts.values()]), strict=True))


def test_alignment_of_odd_texts_in_small_blocks(spark, edge, empty):
    odd = list(enumerate([*strings(400, 5), *strings(20, 5)])) + [(None, "x y"), (1, None)]
    found = Counter((r.doc_id, *digest(r)) for r in alignment.align(spark.createDataFrame(odd, "doc_id long, text string").repartition(3), JSON, MODEL, block_bytes=500).collect())
    assert found == Counter((i, *d) for (i, _), d in zip(odd, plain_alignment([t or "" for _, t in odd]), strict=True))
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    assert Counter((r.doc_id, *digest(r)) for r in alignment.align(edge, JSON, MODEL).collect()) == Counter((i, *d) for (i, _), d in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    assert alignment.align(empty, JSON, MODEL).collect() == []


def test_coalesced_by_brute_force():
    r = random.Random(0)
    for _ in range(300):
        n = r.randrange(1, 30)
        cuts = lambda: sorted({0, n, *(r.randrange(n + 1) for _ in range(r.randrange(8)))})
        (a, b) = ([np.array(x) for x in (c[:-1], c[1:])] for c in (cuts(), cuts()))
        group_a, group_b, link_a, link_b = alignment.coalesced(*a, *b)
        assert list(zip(link_a.tolist(), link_b.tolist())) == [(i, j) for i in range(len(a[0])) for j in range(len(b[0])) if a[0][i] < b[1][j] and b[0][j] < a[1][i]]
        both = sorted(set(a[1].tolist()) & set(b[1].tolist()))
        for side, group in ((a, group_a), (b, group_b)):
            assert group.tolist() == [sum(z <= x for z in both) for x in side[0].tolist()]


def test_places_are_packed_and_read_back():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        for top in (1, 127, 128, 20000, 2**31):
            x = np.sort(r.integers(0, top, n))
            assert alignment.unpacked(alignment.packed(x)).tolist() == x.tolist()
