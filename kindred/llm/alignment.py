"""Alignment of two tokenizers' tokens on the bytes of one text.

A is a byte-level BPE, B a piece vocabulary of the sentencepiece library with byte
fallback; both cover a space and the text. All tokens of both, of many texts laid end to end,
are lexsorted by start; the running maximum of ends (maximum.accumulate) tells where a group
begins: at a token that starts at or after it. Within groups, A's token is linked with each
of B's whose bytes overlap, which are a run of B's tokens.

Chunks (see ``bpe.cut``) end where tokens of both end: A's pattern cuts there, and no
piece of B holds its sign for a space behind another sign, which is tried when B is opened; a B
that does is given whole texts. What a chunk has is kept, and a text's groups and links are those of its
chunks in turn.

How Spark runs it. Texts are aligned in blocks of about ``block_bytes``, without a
shuffle. A block writes its texts' links as places in its list of distinct pairs, and that list
with the number of texts that hold each. Only the lists are summed by pair, and the sums
come back by block: rows of a block and pair, so that neither a frequent pair nor a hot
source gathers in one task. Then the texts of a block meet its sums.

Defined cases: texts that are null, empty or whose tokens' bytes differ from the
text's have zeros and no groups; repeated rows count as documents each; of pairs that are as
frequent all are best; an empty table gives no rows; a text of any length is aligned whole
(its block is then larger); other columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import storage
from .bpe import ByteBpe, Kept, cut, repeated
from .rows import slices

SPACE = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: Blocks that one partition can number.
SPAN = 1 << 32
_opened: dict[tuple, "Aligner"] = {}


class Pieces:
    """B: ids of texts and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.tokens = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.by_chunk = not any(SPACE in n.lstrip(SPACE) for n in names)

    def ids_of(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the model adds itself."""
        return self.model.encode([c[1:].decode() for c in chunks], num_threads=1)


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the tokens of A and of B, numbered from 0, and the links: for each the place of A's and of B's token.

    Tokens of each side come in order and do not overlap each other."""
    n = len(start_a)
    starts, ends = np.r_[start_a, start_b], np.r_[end_a, end_b]
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    begins = np.r_[True, starts[order][1:] >= reach[:-1]] if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    sizes = np.maximum(high - low, 0)
    link_a = np.repeat(np.arange(n), sizes)
    link_b = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
    return group[:n], group[n:], link_a, link_b


class Aligner:
    """What each chunk has: whether its bytes are kept, numbers of tokens, groups and links, the groups as text, and the links' pairs."""

    def __init__(self, a: str, b: str, most: int = 200_000) -> None:
        self.a, self.b = ByteBpe(a, most=1), Pieces(b)
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a.tokens, self.b.tokens))
        #: Ids of A that begin a group or follow in it, then those of B, each behind the sign that stands before it.
        self.names = [sign + str(i) for sign, n in ((";", len(self.a.tokens)), (",", len(self.a.tokens)), ("|", len(self.b.tokens)), (",", len(self.b.tokens))) for i in range(n)]
        self.kept = Kept(self.learn, most)

    def learn(self, chunks: list[bytes]) -> list[tuple]:
        ids_a, ids_b = self.a.ids_of(chunks), self.b.ids_of(chunks)
        good = list(range(len(chunks)))
        flat = lambda: (np.frombuffer(b"".join([ids_a[i] for i in good]), "<u4").astype(np.int64), np.array([t for i in good for t in ids_b[i]], np.int64))
        a, b = flat()
        if not b"".join(map(self.a.tokens.__getitem__, a.tolist())) == b"".join(chunks) == b"".join(map(self.b.tokens.__getitem__, b.tolist())):
            of_a = lambda i: b"".join(map(self.a.tokens.__getitem__, np.frombuffer(ids_a[i], "<u4").tolist()))
            good = [i for i, c in enumerate(chunks) if of_a(i) == c == b"".join(map(self.b.tokens.__getitem__, ids_b[i]))]
            a, b = flat()
        out: list[tuple] = [(False, 0, 0, 0, 0, "", b"")] * len(chunks)
        if not good:
            return out
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        group_a, group_b, link_a, link_b = coalesced(end_a - self.size_a[a], end_a, end_b - self.size_b[b], end_b)
        n_a, n_b = np.cumsum([0, *(len(ids_a[i]) // 4 for i in good)]), np.cumsum([0, *(len(ids_b[i]) for i in good)])
        first = np.r_[group_a[n_a[:-1]], group_a[-1] + 1]  # group with which each chunk begins
        # tokens in the order of groups and, in these, of A and B, each behind its sign
        place_a, place_b = np.arange(len(a)) + np.searchsorted(group_b, group_a), np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        shown = np.empty(len(a) + len(b), np.int64)
        shown[place_a] = a + len(self.a.tokens) * (np.diff(group_a, prepend=-1) == 0)
        shown[place_b] = b + 2 * len(self.a.tokens) + len(self.b.tokens) * (np.diff(group_b, prepend=-1) == 0)
        names = list(map(self.names.__getitem__, shown.tolist()))
        pairs, at = a[link_a] << 32 | b[link_b], np.searchsorted(link_a, n_a)
        data, ends, cuts = pairs.tobytes(), (8 * at).tolist(), (n_a + n_b).tolist()
        numbers = zip(*(np.diff(x).tolist() for x in (n_a, n_b, first, at)), strict=True)
        for k, (i, row) in enumerate(zip(good, numbers, strict=True)):
            out[i] = (True, *row, "".join(names[cuts[k] : cuts[k + 1]])[1:], data[ends[k] : ends[k + 1]])
        return out

    def block(self, texts: list[bytes]) -> tuple[dict, list[np.ndarray], np.ndarray]:
        """Columns of the texts, the links of each (pairs, in order, as often as they occur), and the distinct pairs."""
        spaced = [b" " + t if t else b"" for t in texts]
        data, bounds, chunks = cut(spaced) if self.b.by_chunk else (b"".join(spaced), np.unique(np.cumsum([0, *map(len, spaced)])), np.array([int(bool(t)) for t in spaced], np.int64))
        distinct, at = repeated(data, bounds) if data else ([], np.empty(0, np.int64))
        has = self.kept(distinct)
        text = np.repeat(np.arange(len(texts)), chunks)
        fine = np.array([h[0] for h in has], bool)
        good = np.bincount(text, ~fine[at], len(texts)) == 0
        good &= chunks > 0
        numbers = np.array([h[1:5] for h in has], np.int64).reshape(-1, 4)
        # empty texts have no chunks
        sums = np.stack([np.bincount(text, numbers[at, k], len(texts)) for k in range(4)], 1).astype(np.int64)
        sums[~good] = 0
        found = dict(zip(COUNTS, sums.T, strict=True))
        names, ends = [h[5] for h in has], np.cumsum(chunks).tolist()
        digest = lambda places: hashlib.sha256(";".join([names[i] for i in places]).encode()).hexdigest()
        found["groups_sha256"] = [digest(at[e - n : e].tolist()) if g else "" for e, n, g in zip(ends, chunks.tolist(), good.tolist(), strict=True)]
        # chunks of a text in the order of their numbers, then their pairs as places in the block's list
        every = np.frombuffer(b"".join(h[6] for h in has), np.int64)
        pairs, place = np.unique(every, return_inverse=True)
        size = numbers[:, 3] if len(numbers) else np.empty(0, np.int64)
        some = good[text]
        taken, owner = at[some], text[some]
        n = size[taken]
        total = np.cumsum(n)
        source = np.arange(total[-1] if len(total) else 0) + np.repeat((np.cumsum(size) - size)[taken] - (total - n), n)
        keys = np.sort(np.repeat(owner, n) * max(1, len(pairs)) + place[source])
        links = np.split(keys % max(1, len(pairs)), np.searchsorted(keys // max(1, len(pairs)), np.arange(1, len(texts))))
        return found, links, pairs


def opened(a: str, b: str) -> Aligner:
    if (a, b) not in _opened:
        _opened[a, b] = Aligner(a, b)
    return _opened[a, b]


def packed(places: np.ndarray) -> bytes:
    """Numbers in ascending order as differences of seven bits a byte."""
    left = np.diff(places, prepend=0)
    out = []
    while True:
        out.append((left & 127 | (left >= 128) << 7).astype(np.uint8))
        left = left >> 7
        if not left.any():
            break
    table = np.stack(out, 1)
    used = np.c_[np.ones(len(table), bool), table[:, :-1] >= 128]
    return table[np.logical_and.accumulate(used, 1)].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    begins = np.r_[True, raw[:-1] < 128] if len(raw) else np.empty(0, bool)
    number = np.cumsum(begins) - 1
    step = np.arange(len(raw)) - np.flatnonzero(begins)[number] if len(raw) else raw
    return np.cumsum(np.bincount(number, (raw & 127) << 7 * step).astype(np.int64)) if len(raw) else raw


ALIGNED = "block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair_a array<int>, pair_b array<int>, pair_docs array<int>"


def aligned(docs: DataFrame, a: str, b: str, block_bytes: int = 8_000_000) -> DataFrame:
    """A row for each text; the first of each block has the block's distinct pairs, and the number of its texts that hold each."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(ALIGNED).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = opened(a, b), TaskContext.get().partitionId() * SPAN
        for batch in batches:
            for part, texts in slices(batch, 1, block_bytes):
                found, links, pairs = aligner.block(texts)
                held = np.bincount(np.concatenate([np.unique(x) for x in links]), minlength=len(pairs))
                first = lambda x: [x, *[None] * (len(texts) - 1)]
                found |= {"block": [number] * len(texts), "links": list(map(packed, links)), "pair_a": first(pairs >> 32), "pair_b": first(pairs & 0xFFFFFFFF), "pair_docs": first(held)}
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *(pa.array(found[f.name], f.type) for f in list(arrow)[1:])], schema=arrow)
                number += 1

    return rows.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, the number of documents that hold them linked (count), and whether no other b of a has more (best)."""
    listed = blocks.where("pair_a is not null").select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("p"))
    counts = listed.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.sum("p.pair_docs").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align(docs: DataFrame, a: str, b: str, block_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text; a and b are the vocabularies' files."""
    blocks = storage.saved(aligned(docs, a, b, block_bytes), "aligned")
    counts = pair_counts(blocks)
    listed = blocks.where("pair_a is not null").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "p")).select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    known = listed.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "place", "count", "best")
    texts = blocks.select("block", "doc_id", *COUNTS, "groups_sha256", "links")
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    arrow = to_arrow_schema(schema)

    def finish(some: pa.Table, sums: pa.Table) -> pa.Table:
        count, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, bool)
        place = sums.column("place").to_numpy()
        count[place], best[place] = sums.column("count").to_numpy(), sums.column("best").to_numpy()
        links = list(map(unpacked, some.column("links").to_pylist()))
        more = {"n_best": [int(best[x].sum()) for x in links], "count_sum": [int(count[x].sum()) for x in links]}
        return pa.Table.from_arrays([pa.array(more[f.name], f.type) if f.name in more else some.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(finish, schema)
