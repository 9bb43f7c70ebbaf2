"""Benchmark decontamination: a BM25 inverted index of test items with block-max WAND.

Every document is cut into overlapping passages, twice as long as the longest item
of an index block and half overlapping, so that each item in a text lies whole in a
passage. Each passage is a query (a set of words) against all items. An item's
postings hold BM25 impacts divided by what it needs: ``share`` of the score that the
item's own words give it; so all items that a passage lifts to 1 are retrieved.
Items are in blocks of ``BLOCK``, and each term has its maximum over all items and
over each block: a passage whose sum of maxima stays below 1 is skipped, then each
block whose sum does, and only the postings of the blocks left are added up. Frequent
words, whose maxima are small, are set aside until a block may reach 1 without them.
What passes is searched by block-max WAND over the postings (``Index.retrieve``).
Retrieved items are verified: of the word trigrams of the item's question and of
its answer, shares of at least ``overlap`` must occur in the passage. An item's answer
is what follows its last '?' or 'Answer:'; without such a mark, or with nothing after
it, the share is that of the whole item.

How Spark runs it. Items in the order of their lengths fill index blocks of about
``index_bytes`` of text, each built in a task of its own and written to the shared
folder. Blocks of at most about ``pass_bytes`` together, a size that is checked, are
broadcast and meet all documents in one scan without a shuffle; more blocks take more
scans. Texts are worked on in pieces of about 1 MB.

Defined cases: null texts and items without words match nothing; repeated rows are
searched each; items with equal texts are all reported, and so are items with equal or
null item_id, each; of passages of a text that hold an item equally well the first is
reported; a text of any length is searched whole; an empty table on either
side gives no rows; other columns are ignored by ``leaks`` and kept by
``drop_contaminated``; rows without doc_id stay in the latter unless they leak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .. import storage
from . import words
from .rows import filter_texts, map_texts

K1, B = 1.2, 0.75
BLOCK = 16
#: Passages are judged together as long as a number for each of them and each item makes no more numbers than this.
CELLS = 500_000
#: Words are runs of letters, digits and bytes beyond ASCII.
BREAK = np.array([not (chr(c).isalnum() or c >= 128) for c in range(256)])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return words.word_hashes(texts, space=BREAK)


def question_and_answer(text: str) -> list[str]:
    """The parts of an item that must occur each: question and answer where a mark parts them, else the whole."""
    marks = list(re.finditer(r"\?|(?i:\banswer\s*:)", text))
    cut = marks[-1].end() if marks else 0
    return [text[:cut], text[cut:]] if cut and text[cut:].strip() else [text]


def grams(hashed: np.ndarray, n: int = 3) -> np.ndarray:
    """Hashes of the runs of n words; of all words if there are fewer."""
    n = min(n, len(hashed))
    out = np.zeros(len(hashed) - n + 1, np.uint64) if n else np.empty(0, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[j : len(hashed) - n + 1 + j]
    return out


def expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all the ranges, and for each its range."""
    many = last - first
    own = np.repeat(np.arange(len(many)), many)
    return np.arange(len(own)) - np.repeat(np.cumsum(many) - many - first, many), own


class Index:
    """Items of one index block, as arrays that one buffer holds: an index that is read shares its memory.

    Items have numbers from 0. Postings lie by term and item; each term has its greatest
    impact over all items and over each block of ``BLOCK`` items.
    """

    #: Name and type of each array, in the order of the buffer.
    LAYOUT = (
        ("terms", "<u8"), ("impact", "<f4"), ("most", "<f4"), ("block_most", "<f4"), ("item", "<i4"), ("first", "<i4"), ("last", "<i4"), ("block", "<i4"), ("block_first", "<i4"), ("block_last", "<i4"),
        ("check_item", "<i4"), ("check_first", "<i4"), ("check_last", "<i4"), ("check_words", "<i4"), ("check_grams", "<u8"),
    )

    @classmethod
    def build(cls, texts: list[str], frequencies: list[dict[int, int]], n_items: int, mean_length: float, share: float) -> bytes:
        """The buffer of an index; frequencies: of each text, the items that hold a term, by term."""
        term, item, impact, checks = [], [], [], []
        longest = 0
        for i, (text, frequency) in enumerate(zip(texts, frequencies, strict=True)):
            h = tokens([text.encode()])[0]
            longest = max(longest, len(h))
            t, c = np.unique(h, return_counts=True)
            if not len(t):
                continue
            df = np.array([frequency.get(x, 1) for x in t.view(np.int64).tolist()])
            w = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(h) / max(mean_length, 1e-9)))
            term.append(t)
            item.append(np.full(len(t), i))
            impact.append(w / (share * w.sum()))
            for part in question_and_answer(text):
                if len(h := tokens([part.encode()])[0]):
                    checks.append((i, min(3, len(h)), np.unique(grams(h))))
        term, item, impact = (np.concatenate(x) if x else np.empty(0, d) for x, d in ((term, np.uint64), (item, np.int64), (impact, float)))
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order].astype("<f4")
        terms, first = np.unique(term, return_index=True)
        place = np.repeat(np.arange(len(terms)), np.diff(np.r_[first, len(term)]))
        width = len(texts) // BLOCK + 1
        blocks, start = np.unique(place * width + item // BLOCK, return_index=True)
        block_first = np.searchsorted(blocks // width, np.arange(len(terms)))
        sizes = np.array([len(g) for _, _, g in checks], np.int64)
        found = {
            "terms": terms, "impact": impact, "most": np.maximum.reduceat(impact, first) if len(terms) else [], "block_most": np.maximum.reduceat(impact, start) if len(blocks) else [], "item": item, "first": first,
            "last": np.r_[first[1:], len(term)] if len(terms) else [], "block": blocks % width, "block_first": block_first, "block_last": np.r_[block_first[1:], len(blocks)] if len(terms) else [],
            "check_item": [i for i, _, _ in checks], "check_first": np.cumsum(sizes) - sizes, "check_last": np.cumsum(sizes), "check_words": [m for _, m, _ in checks], "check_grams": np.concatenate([g for _, _, g in checks]) if checks else [],
        }
        arrays = [np.asarray(found[name]).astype(kind) for name, kind in cls.LAYOUT]
        head = np.array([len(texts), longest, *(len(x) for x in arrays)], "<i8")
        return b"".join([head.tobytes(), *(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays)])

    def __init__(self, buffer: bytes) -> None:
        head = np.frombuffer(buffer, "<i8", 2 + len(self.LAYOUT))
        self.n, self.longest = int(head[0]), int(head[1])
        at = head.nbytes
        for (name, kind), size in zip(self.LAYOUT, head[2:].tolist(), strict=True):
            x = np.frombuffer(buffer, kind, size, at)
            setattr(self, name, x)
            at += x.nbytes + -x.nbytes % 8
        # places of postings and blocks by term and item: both are sorted, so that many cursors move by one search
        place = np.arange(len(self.terms), dtype=np.int64)
        self.width = self.n // BLOCK + 1
        self.postings = np.repeat(place * self.n, self.last - self.first) + self.item
        self.blocks = np.repeat(place * self.width, self.block_last - self.block_first) + self.block
        self.by_most = np.argsort(self.most, kind="stable")  # terms from the least maximum to the greatest
        self.rank = np.empty_like(self.by_most)
        self.rank[self.by_most] = np.arange(len(self.by_most))
        self.checks_of = np.searchsorted(self.check_item, np.arange(self.n + 1))
        bits = max(8, (4 * len(self.terms)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)  # a quick test before the search for a term
        self.maybe[(self.terms >> self.shift).astype(np.int64)] = True

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Place of each word among the terms, or -1."""
        out = np.full(len(hashed), -1)
        some = np.flatnonzero(self.maybe[(hashed >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, hashed[some]), len(self.terms) - 1)
        hit = self.terms[at] == hashed[some]
        out[some[hit]] = at[hit]
        return out

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items that the set of terms lifts to 1, by block-max WAND.

        Each term has a cursor in its postings. Terms are kept in the order of their
        cursors' items; the pivot is the first at which the sum of maxima reaches 1, as
        no item before the pivot's can. If the maxima of the pivot's block do not reach
        1 either, the cursors go on behind that block; else to the pivot's item, which is
        scored once all of them stand on it.
        """
        enough = 1 - 1e-6
        at, last = self.first[terms].astype(np.int64), self.last[terms].astype(np.int64)
        out = []
        while len(terms):
            item = self.item[at]
            order = np.argsort(item, kind="stable")
            terms, at, last, item = terms[order], at[order], last[order], item[order]
            reach = np.flatnonzero(np.cumsum(self.most[terms], dtype=float) >= enough)
            if not len(reach):
                break
            pivot = int(item[reach[0]])
            upto = int(np.searchsorted(item, pivot, "right"))  # cursors at the pivot's item or before it
            if self.ceiling(terms[:upto], pivot // BLOCK) < enough:
                beyond = (pivot // BLOCK + 1) * BLOCK
                goal = min(beyond, int(item[upto])) if upto < len(item) else beyond
            elif item[0] == pivot:
                score = float(self.impact[at[:upto]].sum(dtype=float))
                if score >= enough:
                    out.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            at[:upto] = np.maximum(at[:upto], np.searchsorted(self.postings, terms[:upto] * self.n + goal))
            open_ = at < last
            if not open_.all():
                terms, at, last = terms[open_], at[open_], last[open_]
        return out

    def ceiling(self, terms: np.ndarray, block: int) -> float:
        """The sum of the terms' maxima in a block."""
        wanted = terms * self.width + block
        k = np.minimum(np.searchsorted(self.blocks, wanted), len(self.blocks) - 1)
        return float(self.block_most[k[self.blocks[k] == wanted]].sum(dtype=float))

    def promising(self, place: np.ndarray, counts: np.ndarray, starts: np.ndarray, n: np.ndarray, before: np.ndarray, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """Passages, with their terms, of which the maxima of some block may reach 1.

        A passage's terms of the least maxima, up to half of what is needed, are set
        aside: an item that reaches 1 has the other half from the rest, whose postings
        are short.
        """
        word = np.flatnonzero(place >= 0)
        of = np.repeat(np.arange(len(counts)), counts)[word]
        segment = (word - starts[of]) // step
        keys = [(before[of[ok]] + segment[ok] - d) * len(self.terms) + self.rank[place[word[ok]]] for d in (0, 1) if (ok := (segment >= d) & (segment - d < n[of])).any()]
        if not keys:
            return
        keys = np.unique(np.concatenate(keys))
        passage, term = keys // len(self.terms), self.by_most[keys % len(self.terms)]
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        size = np.diff(np.r_[first, len(passage)])
        most = self.most[term]
        sums = np.cumsum(most)
        total = np.add.reduceat(most, first)
        inside = sums - np.repeat(sums[first] - most[first], size)
        aside = np.add.reduceat(np.where(inside < 0.5, most, 0), first)
        strong = np.flatnonzero((inside >= 0.5 - 1e-9) & np.repeat(total >= 1 - 1e-9, size))
        if not len(strong):
            return
        group = np.repeat(np.arange(len(first)), size)[strong]
        width, items = int(self.block.max()) + 1, self.n
        bounds = np.searchsorted(group, np.arange(0, len(first) + (each := max(1, CELLS // items)), each))
        for low, high in zip(bounds, bounds[1:], strict=False):  # so many passages that a number for each and item is kept
            if low == high:
                continue
            t, row = term[strong[low:high]], group[low:high] - group[low]
            rest = aside[group[low] : group[high - 1] + 1, None]
            entry, own = expanded(self.block_first[t], self.block_last[t])
            ceiling = np.bincount(row[own] * width + self.block[entry], self.block_most[entry], len(rest) * width).reshape(-1, width)
            alive = ceiling + rest >= 1 - 1e-6
            some = alive.any(1)[row]
            t, row = t[some], row[some]
            entry, own = expanded(self.first[t], self.last[t])
            good = alive[row[own], self.item[entry] // BLOCK]
            entry, own = entry[good], own[good]
            score = np.bincount(row[own] * items + self.item[entry], self.impact[entry], len(rest) * items).reshape(-1, items)
            for g in (group[low] + np.flatnonzero((score + rest >= 1 - 1e-6).any(1))).tolist():
                yield int(passage[first[g]]), term[first[g] : first[g] + size[g]]

    def search(self, hashed: np.ndarray, counts: np.ndarray, overlap: float) -> list[tuple[int, int, int, int, float, float]]:
        """(text, item, first word, past-last word, score, least share) of each text's best passage for each verified item."""
        best: dict[tuple[int, int], tuple] = {}
        if not len(self.terms) or not len(hashed):
            return []
        place = self.places(hashed)
        step = max(1, self.longest)
        ends = np.cumsum(counts)
        starts = ends - counts
        n = np.maximum(1, -(-counts // step) - 1)  # passages of each text
        before = np.cumsum(n) - n
        text = np.repeat(np.arange(len(counts)), n)
        a = starts[text] + (np.arange(len(text)) - before[text]) * step
        z = np.minimum(a + 2 * step, ends[text])
        for k, terms in self.promising(place, counts, starts, n, before, step):
            for i, score in self.retrieve(terms):
                least = min((self.held(c, hashed[a[k] : z[k]]) for c in range(self.checks_of[i], self.checks_of[i + 1])), default=0.0)
                key = (int(text[k]), i)
                if least >= overlap and (key not in best or (least, score) > best[key][2:4]):
                    best[key] = (int(a[k] - starts[text[k]]), int(z[k] - starts[text[k]]), float(least), score)
        return [(t, i, first, last, score, least) for (t, i), (first, last, least, score) in sorted(best.items())]

    def held(self, check: int, passage: np.ndarray) -> float:
        """Share of the grams of a part that occur in the passage."""
        wanted = self.check_grams[self.check_first[check] : self.check_last[check]]
        return float(np.isin(wanted, grams(passage, int(self.check_words[check]))).mean())


def indexes(items: DataFrame, share: float, index_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Tables (block, size, buffer) of the index blocks and (block, item, item_id) of what is in them.

    Items, from the shortest to the longest, fill blocks of about ``index_bytes`` of text;
    a longer item has a block of its own. Each block is built in a task of its own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = items.select("item_id", text.alias("text"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("tie"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    if total <= index_bytes:
        blocked = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        blocked = storage.running(rows, F.col("bytes"), "bytes", "tie").withColumn("block", F.floor(F.col("before") / index_bytes))
    blocked = storage.saved(blocked.select("block", "item_id", "text", F.monotonically_increasing_id().alias("row")), "items")

    def count(texts: list[bytes]) -> dict:
        hashed, counts = tokens(texts)
        ends = np.cumsum(counts)
        return {"terms": [np.unique(hashed[z - n : z]).view(np.int64) for z, n in zip(ends, counts, strict=True)], "length": counts}

    listed = storage.saved(map_texts(blocked, count, "terms array<long>, length long", as_bytes=True, key="row"), "item-terms")
    n_items, mean = listed.where("length > 0").agg(F.count("*"), F.avg("length")).first()
    held = listed.select("row", F.explode("terms").alias("term"))
    frequency = held.groupBy("term").agg(F.count("*").alias("n"))
    of_item = held.join(frequency, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("frequency"))
    full = blocked.join(of_item, "row").select("block", "row", "text", "frequency")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        buffer = Index.build(table.column("text").to_pylist(), [dict(x) for x in table.column("frequency").to_pylist()], n_items, mean, share)
        return pa.table({"block": table.column("block").slice(0, 1), "size": pa.array([len(buffer)], pa.int64()), "buffer": pa.array([buffer], pa.binary())})

    built = storage.saved(full.groupBy("block").applyInArrow(build, "block long, size long, buffer binary"), "index")
    # the place of an item in its block: the order of rows, as above
    place = F.row_number().over(Window.partitionBy("block").orderBy("row")) - 1
    names = blocked.join(of_item.select("row"), "row", "left_semi").select("block", place.alias("item"), "item_id")
    return built, storage.saved(names, "item-names")


def runs(built: DataFrame, pass_bytes: int) -> Iterator[list[int]]:
    """The numbers of the blocks in runs of at most about ``pass_bytes``."""
    sizes = built.select("block", "size").orderBy("block").collect()  # two numbers for each block
    run, held = [], 0
    for block, size in [*sizes, (None, 0)]:
        if run and (block is None or held + size > pass_bytes):
            yield run
            run, held = [], 0
        run.append(block)
        held += size


def passes(built: DataFrame, pass_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The index blocks in runs of at most about ``pass_bytes``, one run at a time on the driver."""
    for run in runs(built, pass_bytes):
        yield [(r.block, bytes(r.buffer)) for r in built.where(F.col("block").between(run[0], run[-1])).orderBy("block").collect()]


def searcher(shared, overlap: float):
    """A function from texts to hits (text, block, item, first word, last word, score, share) in the index blocks of a broadcast."""
    opened: list[tuple[int, Index]] = []

    def find(texts: list[bytes]) -> list[tuple]:
        if not opened:
            opened.extend((block, Index(buffer)) for block, buffer in shared.value)
        out = []
        for a, b in words.blocks(texts, 1_000_000):
            hashed, counts = tokens(texts[a:b])
            for block, index in opened:
                out += [(t + a, block, *rest) for t, *rest in index.search(hashed, counts, overlap)]
        return out

    return find


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.6, index_bytes: int = 2 << 20, pass_bytes: int = 128 << 20) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, first_word and
    last_word (exclusive) of the best passage, score (1: the least that is retrieved),
    overlap (the lower share of the question's and the answer's trigrams)."""
    spark = docs.sparkSession
    built, names = indexes(items, share, index_bytes)
    columns = "block long, item int, first_word long, last_word long, score double, overlap double"
    found = spark.createDataFrame([], StructType([docs.schema["doc_id"], *StructType.fromDDL(columns).fields]))
    for blocks in passes(built, pass_bytes):
        shared = spark.sparkContext.broadcast(blocks)

        def search(texts: list[bytes], find=searcher(shared, overlap)) -> dict:
            hits: list[list] = [[] for _ in texts]
            for t, *hit in find(texts):
                hits[t].append(dict(zip(("block", "item", "first_word", "last_word", "score", "overlap"), hit, strict=True)))
            return {"hits": hits}

        rows = map_texts(docs, search, "hits array<struct<block: long, item: int, first_word: long, last_word: long, score: double, overlap: double>>", as_bytes=True)
        found = found.unionByName(rows.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*"))
    return found.join(names, ["block", "item"]).select("doc_id", "item_id", "first_word", "last_word", "score", "overlap")


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.6, overlap: float = 0.6, index_bytes: int = 2 << 20, pass_bytes: int = 128 << 20) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns."""
    built, _ = indexes(items, share, index_bytes)
    for blocks in passes(built, pass_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(blocks)

        def keep(texts: list[str | None], find=searcher(shared, overlap)) -> list[bool]:
            good = [True] * len(texts)
            for t, *_ in find([(x or "").encode() for x in texts]):
                good[t] = False
            return good

        docs = filter_texts(docs, keep)
    return docs
