"""Hierarchical packing of tokenized documents into windows of several lengths.

A document is routed to the tier of the smallest window that holds it; of one that is
longer than the longest window, full windows are cut off first. The longest document
that waits opens a window of its tier, and the gap behind it is filled from shorter
tiers: by one, two or three whole documents that fill it exactly where there are such,
else by the longest that fit, and what is then left by the start of a document whose
rest waits on. Windows are powers of two up to ``longest``; a sequence that is not full
is padded to ``longest``.

How Spark runs it. Each partition tokenizes and packs its own documents, so that
neither texts nor ids are shuffled; about ``held_tokens`` wait at a time. What a partition
cannot fill, less than the shortest window, is packed again among the leftovers of
``merge`` partitions: a row or so each. Sequences, from the longest windows to the
shortest, are dealt in turn over ``step_groups`` groups by counts of the partitions, so
that the groups' windows differ by at most one window in sum.

Defined cases: null text is an empty one (its end id alone); repeated rows are
packed each; of documents of one length the one that came last is taken first; a text of
any length is packed whole; an empty table gives no rows; other columns are ignored; a null
doc_id is kept.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import storage
from .rows import slices
from .words import blocks

LONGEST, SHORTEST = 4096, 128
#: Sequences that one partition can number.
SPAN = 1 << 32
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, part int, local long, offset long, window int, turn long"
#: Texts by which a tokenizer shows whether it works word by word.
PROBES = ("Two words, and more: x.", "a\n\tb  c\r d ", "ÉTÉ Straße naïve co-op don't 3.14 x_y", "UPPER lower Title", "你好 世界 😀 ünïcödé", "((a)) [b]{c} <d> #1 $5 100%!?", "")
_encoders: dict[str, "WordEncoder"] = {}


#: A word of Latin-1 letters and what follows it: the vocabularies here fold case and cut between letters and signs.
SIGNS = ".,;:!?#$%&*"
CORE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*]*)")


class WordEncoder:
    """Ids of texts as little-endian 32-bit numbers, from a cache by word.

    A vocabulary that drops white space, never joins over it and folds case has the ids
    of a text's words in turn; whether it does is tried on ``PROBES``. Any other one
    encodes whole texts. The cache has two generations of at most ``most`` words; the
    older goes when the younger is full.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.young, self.old, self.most = Tokenizer.from_file(path), {"": b""}, {}, most
        self.model, bytes_of = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {n: bytes_of.pre_tokenize_str(chr(n))[0][0] for n in range(0xC0, 0x100)}
        self.by_word = True
        self.by_word = self(list(PROBES)) == self.whole(list(PROBES))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word; new ones go into the younger generation."""
        known = list(map(self.young.get, words))
        if new := [w for w, ids in zip(words, known, strict=True) if ids is None]:
            if len(self.young) + len(new) > self.most:
                self.old, self.young = self.young, {"": b""}
            self.learn(new)
            known = [self.young[w] if ids is None else ids for w, ids in zip(words, known, strict=True)]
        return known

    def learn(self, new: list[str]) -> None:
        young, old, rest = self.young, self.old, []
        for w in new:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                continue
            core = w.rstrip(SIGNS)
            if not (core.isascii() and core.isalpha()):
                if not (m := CORE.fullmatch(w)):
                    rest.append(w)
                    continue
                core = m[1]
            low = core.lower()
            ids = young.get(low)
            if ids is None:
                ids = young[low] = self.letters_only(low)
            if signs := w[len(core) :]:
                if signs not in young:
                    young[signs] = self.whole([signs])[0]
                ids += young[signs]
            young[w] = ids
        young.update(zip(rest, self.whole(rest), strict=True))

    def letters_only(self, word: str) -> bytes:
        """Ids of a word of lower-case Latin-1 letters, which the vocabulary does not cut before it merges."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [x for a, b in blocks(texts, 500_000) for x in self.whole(texts[a:b])]
        out = []
        for a, b in blocks(texts, 1_000_000):
            # white space as Arrow sees it takes in four control signs that the tokenizer does not
            if any(c in t for t in texts[a:b] for c in "\x1c\x1d\x1e\x1f"):
                cut = pa.array([re.split("[ \n\t\r]+", t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts[a:b]], pa.list_(pa.string()))
            else:
                cut = pc.utf8_split_whitespace(pa.array(texts[a:b], pa.string()))
            coded = cut.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            out += gathered(self.ids(words), coded.indices.to_numpy(), cut.offsets.to_numpy())
        return out


def gathered(ids: list[bytes], at: np.ndarray, offsets: np.ndarray, most: int = 200_000) -> list[bytes]:
    """The ids of words ``at``, joined from each offset to the next; ``most`` words are taken at a time."""
    flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
    starts, ends, parts = np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum(sizes[at])]), []
    for i in range(0, len(at), most):
        some = at[i : i + most]
        shift = starts[some] - ends[i : i + len(some)]
        parts.append(flat[np.arange(ends[i], ends[i + len(some)]) + np.repeat(shift, sizes[some])].tobytes())
    joined, bounds = b"".join(parts), (4 * ends[offsets]).tolist()
    return [joined[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def windows(longest: int = LONGEST, shortest: int = SHORTEST) -> list[int]:
    out = [longest]
    while out[-1] // 2 >= shortest:
        out.append(out[-1] // 2)
    return out


class Packer:
    """Fills windows from a stream of pieces (document, start, length), of which about ``held_tokens`` wait."""

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST, held_tokens: int = 1 << 18) -> None:
        self.sizes, self.held_tokens = windows(longest, shortest), max(held_tokens, 2 * longest)  # enough to fill a window
        self.waiting: dict[int, list] = {}
        self.have = np.zeros(longest + 1, bool)
        self.tokens = 0
        self.full: list[tuple[int, list]] = []

    def add(self, document, length: int) -> None:
        longest, start = self.sizes[0], 0
        while length - start >= longest:
            self.full.append((longest, [(document, start, longest)]))
            start += longest
        if length > start:
            self.put((document, start, length - start))
        while self.tokens > self.held_tokens:
            self.fill()

    def put(self, piece: tuple) -> None:
        self.waiting.setdefault(piece[2], []).append(piece)
        self.have[piece[2]] = True
        self.tokens += piece[2]

    def take(self, length: int) -> tuple:
        found = self.waiting[length]
        piece = found.pop()
        if not found:
            del self.waiting[length]
            self.have[length] = False
        self.tokens -= length
        return piece

    def longest_of(self, most: int) -> int:
        """The greatest length up to ``most`` that waits, or 0."""
        found = self.have[most::-1]
        at = int(found.argmax())
        return most - at if found[at] else 0

    def two(self, gap: int) -> list[int]:
        """Lengths of one or two waiting pieces that fill the gap, or none."""
        if self.have[gap]:
            return [gap]
        pairs = np.flatnonzero(self.have[1:gap] & self.have[gap - 1 : 0 : -1])[::-1] + 1
        return next(([a, gap - a] for a in pairs.tolist() if 2 * a > gap or 2 * a == gap and len(self.waiting[a]) > 1), [])

    def three(self, gap: int) -> list[int]:
        """The same for three, the first of which is among the longest that fit."""
        for a in np.flatnonzero(self.have[1:gap])[:-9:-1].tolist():
            piece = self.take(a + 1)
            found = self.two(gap - a - 1)
            self.put(piece)
            if found:
                return [a + 1, *found]
        return []

    def fill(self, most: int | None = None) -> None:
        """Fills one window, of at most ``most`` tokens; as many must wait."""
        n = self.longest_of(len(self.have) - 1)
        window = next(w for w in reversed(self.sizes) if n <= w)
        if most and window > most:
            window = most
        if n > window:
            taken, gap = [], window
        else:
            taken, gap = [self.take(n)], window - n
        while gap:
            if found := self.two(gap) or self.three(gap):
                taken += map(self.take, found)
                break
            if n := self.longest_of(gap):
                taken.append(self.take(n))
                gap -= n
            else:
                document, start, n = self.take(self.longest_of(len(self.have) - 1))
                taken.append((document, start, gap))
                self.put((document, start + gap, n - gap))
                break
        self.full.append((window, taken))

    def close(self) -> list:
        """Packs what waits; returns the pieces, shorter together than the shortest window, that are left."""
        while self.tokens >= self.sizes[-1]:
            self.fill(next(w for w in self.sizes if w <= self.tokens))
        return [p for pieces in self.waiting.values() for p in pieces]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = LONGEST, shortest: int = SHORTEST, step_groups: int = 8, merge: int = 256, held_tokens: int = 1 << 18) -> DataFrame:
    """Packs every text; one row for each piece of a document.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window (length of the sequence with its padding) and step_group. The ids of a
    piece are those of its document from ``start`` on.
    """
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(PIECE).fields])
    arrow = to_arrow_schema(schema)

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, part = encoder(tokenizer), Packer(longest, shortest, held_tokens), TaskContext.get().partitionId()
        end, local, turns = end_id.to_bytes(4, "little"), 0, Counter()

        def rows(sequences: list[tuple[int, list]]) -> pa.RecordBatch:
            nonlocal local
            out = []
            for window, pieces in sequences:
                offset = 0
                for (doc, ids), start, n in pieces:
                    out.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, part, local, offset, window, turns[window]))
                    offset += n
                local += 1
                turns[window] += 1
            columns = zip(*out, strict=True) if out else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for some, texts in slices(batch, 1):
                for doc, ids in zip(some.column(0).to_pylist(), encode([t or "" for t in texts]), strict=True):
                    packer.add((doc, ids + end), len(ids) // 4 + 1)
                ready, packer.full = packer.full, []
                yield rows(ready)
        rest = packer.close()
        yield rows(packer.full)
        yield rows([(0, rest)])

    packed = storage.saved(docs.select("doc_id", "text").mapInArrow(pack_partition, schema), "packed")

    def pack_rest(table: pa.Table) -> pa.Table:
        """Whole pieces only: a leftover is shorter than the shortest window, and is not cut again."""
        out, local, offset = [], 0, 0
        for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"])):
            if offset + r["length"] > longest:
                local, offset = local + 1, 0
            out.append(r | {"part": -1 - r["part"] // merge, "local": local, "offset": offset, "window": longest, "turn": local})
            offset += r["length"]
        return pa.Table.from_pylist([{k: r[k] for k in arrow.names} for r in out], schema=arrow)

    rest = storage.saved(packed.where("window = 0").groupBy((F.col("part") / merge).cast("int").alias("run")).applyInArrow(pack_rest, schema), "rest")
    whole = packed.where("window > 0").unionByName(rest)
    # sequences of earlier partitions and longer windows come before in the dealing
    counted = whole.groupBy("part", "window").agg((F.max("turn") + 1).alias("n")).withColumn("shortness", -F.col("window"))
    before = storage.running(counted, F.col("n"), "shortness", "part").select("part", "window", "before")
    # even numbers for the partitions' own sequences, odd ones for those of leftovers
    number = F.when(F.col("part") >= 0, F.col("part") * 2).otherwise(F.col("part") * -2 - 1).cast("long")
    return whole.join(before, ["part", "window"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (number * SPAN + F.col("local")).alias("sequence_id"), "offset",
        F.col("window").cast("long").alias("window"), ((F.col("before") + F.col("turn")) % step_groups).cast("int").alias("step_group"),
    )
