"""Byte-level BPE encoding to ids with offsets, and decoding of ids to bytes and texts.

A vocabulary is a file of ranks (base64 of a token's bytes, its rank) or a file of the
tokenizers library. Of ranks a tokenizer of that library is made: bytes are mapped to
characters by the rule of ``byte_characters``, the pattern cuts a text into pieces, a
piece that is a token stays whole, and else the pair that makes the token of the lowest
rank is merged first, so every cut of every token into two tokens is a merge.

Texts are cut before single spaces that a visible character follows. The pattern cuts there too,
whatever stands around, so that the ids of these chunks, joined, are the ids of the
text; they are cut further at line feeds and behind words, and what occurs again is taken from a cache. A token's place is given in
bytes, from the sizes of tokens, and in characters, by counting the bytes that begin
one; a token that holds a part of a character counts as holding it. Decoding looks up
the bytes of each id and joins them before they are read as UTF-8, so that characters that
are split among tokens come back.

How Spark runs it: each text alone, without a shuffle, in slices of about 1 MB.

Defined cases: null text is an empty one and has no ids; repeated rows are
encoded each; an empty table gives no rows; a text of any length is encoded whole; strings of
special tokens are ordinary text; other columns are ignored; a null doc_id is
kept; null ids are none, and an id that the vocabulary lacks has no bytes and is counted.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .rows import map_texts
from .words import blocks

#: Bytes before which a space is not cut off: white space, and the first bytes of characters among which Unicode has white space.
JOINED = np.zeros(256, bool)
JOINED[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
SIGNS = b".,;:!?"
#: Longer chunks are not kept.
LONG = 64
OFFSETS = ("byte_starts", "byte_ends", "char_starts", "char_ends")
_opened: dict[tuple, "ByteBpe"] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: its own where it is visible in Latin-1, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


CHARACTERS = byte_characters()


def of_ranks(path: str, pattern: str):
    """A tokenizer of the tokenizers library, and the bytes of each id, from a file of ranks."""
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    shown = {token: "".join(CHARACTERS[b] for b in token) for token in ranks}
    by_rank = sorted(ranks, key=ranks.get)
    merges = [(shown[t[:i]], shown[t[i:]]) for t in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    made = Tokenizer(BPE({shown[t]: rank for t, rank in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return made, {rank: token for token, rank in ranks.items()}


def of_file(path: str):
    """The same from a file of the tokenizers library whose tokens are byte-level."""
    from tokenizers import Tokenizer

    made, byte = Tokenizer.from_file(path), {c: b for b, c in enumerate(CHARACTERS)}
    made.encode_special_tokens = True
    return made, {i: bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode() for token, i in made.get_vocab().items()}


def cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined bytes, the bounds of all chunks in them, and the number of chunks of each text."""
    joined = b"".join(texts)
    data, sizes = np.frombuffer(joined, np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-2] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & ~JOINED[data[2:]]
    # a space at the end of a text has its next character in another text, and so does not count
    begins[ends[sizes > 0] - 1] = False
    begins[np.r_[0, ends]] = True
    bounds = np.flatnonzero(begins)
    return joined, bounds, np.searchsorted(bounds, ends) - np.searchsorted(bounds, ends - sizes)

def repeated(joined: bytes, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct chunks, and which of them each chunk is."""
    chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined)])
    coded = chunks.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def gather(parts: list[bytes], at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers (as bytes) of the parts ``at``, joined, and how many there are of each."""
    flat, size = np.frombuffer(b"".join(parts), kind), np.dtype(kind).itemsize
    sizes = np.fromiter((len(x) // size for x in parts), np.int64, len(parts))
    taken = sizes[at]
    ends = np.cumsum(taken)
    shift = (np.cumsum(sizes) - sizes)[at] - (ends - taken)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, taken)], taken


def letters(word: str) -> bool:
    """Whether it is Latin letters, perhaps behind a space."""
    return word.removeprefix(" ").isalpha() and (word.isascii() or max(word) < "\u0250")


class Kept:
    """Values by chunk in two generations of at most ``most``; the older goes when the younger is full."""

    def __init__(self, learn: Callable[[list[bytes]], list], most: int) -> None:
        self.learn, self.most, self.young, self.old = learn, most, {}, {}

    def __call__(self, chunks: list[bytes]) -> list:
        found = list(map(self.young.get, chunks))
        late = [i for i, x in enumerate(found) if x is None]
        if not late:
            return found
        some = [self.old.get(chunks[i]) for i in late]
        new = [chunks[i] for i, x in zip(late, some, strict=True) if x is None]
        learnt = iter(self.learn(new) if new else ())
        if len(self.young) + len(late) > self.most:
            self.old, self.young = self.young, {}
        for i, x in zip(late, some, strict=True):
            found[i] = x = next(learnt) if x is None else x
            if len(chunks[i]) <= LONG:
                self.young[chunks[i]] = x
        return found


class ByteBpe:
    """An opened vocabulary: ids of texts, and bytes of ids."""

    def __init__(self, path: str, pattern: str | None = None, most: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, by_id = of_ranks(path, pattern) if pattern else of_file(path)
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.known = np.array([i in by_id for i in range(len(self.tokens))])
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.model = self.tokenizer.model
        self.most, self.of_part = max(most, 1000), {}
        self.kept = Kept(self.ids_of, most)

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each text as 32-bit numbers, put together from those of its parts."""
        parts = [self.parts(c) for c in chunks]
        if len(self.of_part) > self.most:
            self.of_part = {}
        new = []
        for p in {p for some in parts for p in some if p not in self.of_part}:
            if len(p) <= LONG and letters(p.decode()):  # one piece
                self.of_part[p] = array("I", [t.id for t in self.model.tokenize("".join([CHARACTERS[x] for x in p]))]).tobytes()
            else:
                new.append(p)
        texts = [p.decode() for p in new]
        ids = (array("I", e.ids).tobytes() for a, b in blocks(new, 500_000) for e in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False))
        self.of_part.update(zip(new, ids, strict=True))
        return [b"".join([self.of_part[p] for p in some]) for some in parts]

    def parts(self, chunk: bytes) -> list[bytes]:
        """Parts between which the pattern cuts: lines that neither end nor begin with white space, their line feeds, and, of a word of Latin letters with signs behind it, both."""
        lines = chunk.split(b"\n") if len(chunk) <= LONG else [chunk]
        if any(not x or x[-1] <= 0x20 or x[-1] > 0x7E or JOINED[x[0]] for x in lines[1:]) or len(lines) > 1 and (not lines[0] or not 0x20 < lines[0][-1] < 0x7F):
            lines = [chunk]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append(b"\n")
            word = line.rstrip(SIGNS)
            if word and len(word) < len(line) and letters(word.decode()):
                out += [word, line[len(word) :]]
            else:
                out.append(line)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the number of ids of each text."""
        joined, bounds, chunks = cut(texts)
        if not joined:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        distinct, at = repeated(joined, bounds)
        ids, sizes = gather(self.kept(distinct), at, "<u4")
        sums, last = np.r_[0, np.cumsum(sizes)], np.cumsum(chunks)
        return ids, sums[last] - sums[last - chunks]

    def decode(self, ids: Iterable[int | None]) -> tuple[bytes, int]:
        """The bytes of the ids, and how many of them the vocabulary lacks."""
        try:
            if self.known.all() and min(ids, default=0) >= 0:
                return b"".join(map(self.tokens.__getitem__, ids)), 0
        except (IndexError, TypeError):
            pass
        fine = [i for i in ids if i is not None and 0 <= i < len(self.tokens) and self.known[i]]
        return b"".join(map(self.tokens.__getitem__, fine)), sum(i is not None for i in ids) - len(fine)

    def texts(self, ids: Iterable[int]) -> Iterator[str]:
        """What each id adds to the text: a character that is split appears with its last part; what never
        becomes a character is U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield reader.decode(self.tokens[i])
        if rest := reader.decode(b"", True):
            yield rest


def opened(path: str, pattern: str | None = None) -> ByteBpe:
    if (path, pattern) not in _opened:
        _opened[path, pattern] = ByteBpe(path, pattern)
    return _opened[path, pattern]


def places(texts: list[bytes], ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last byte and character of each token in its text; ``ends`` are in the joined texts, and
    ``counts`` says how many tokens each text has."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    before = np.repeat(np.cumsum([0, *map(len, texts)])[:-1], counts)
    begun = np.r_[0, np.cumsum(data & 0xC0 != 0x80)]  # characters that began before each byte
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    first = begun[starts + 1] - 1 if len(ends) else ends  # the character that holds the first byte
    return starts - before, ends - before, first - begun[before], begun[ends] - begun[before]


def encode(docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """doc_id, ids and n_split (tokens that begin or end inside of a character) of every text and, with ``offsets``,
    byte_starts, byte_ends, char_starts and char_ends of each token, ends exclusive."""

    def compute(texts: list[bytes]) -> dict:
        book = opened(path, pattern)
        ids, counts = book.encode(texts)
        ends, cuts = np.cumsum(book.sizes[ids]), np.cumsum(counts)[:-1]
        found = places(texts, ends, counts)
        data = np.r_[np.frombuffer(b"".join(texts), np.uint8), np.uint8(0)]
        inside = data & 0xC0 == 0x80
        split = np.r_[0, np.cumsum(inside[ends - book.sizes[ids]] | inside[ends])]
        last = np.cumsum(counts)
        out = {"ids": np.split(ids.astype(np.int32), cuts), "n_split": split[last] - split[last - counts]}
        if offsets:
            out |= {name: np.split(x.astype(np.int32), cuts) for name, x in zip(OFFSETS, found, strict=True)}
        return out

    more = "".join(f", {x} array<int>" for x in OFFSETS) if offsets else ""
    return map_texts(docs, compute, f"ids array<int>, n_split long{more}", as_bytes=True)


def lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, empty for null ones."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    values = column.flatten()  # of lists that are not null
    values = values.to_pylist() if values.null_count else values.to_numpy().tolist()
    return (values[a:b] for a, b in zip([0, *ends], ends, strict=False))


def decode(rows: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """rows with decoded (the bytes of the ids) and n_unknown, the number of ids that the vocabulary lacks."""
    rows = rows.drop("decoded", "n_unknown")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("decoded binary, n_unknown long").fields])
    arrow, at = to_arrow_schema(schema), rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = opened(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [book.decode(ids) for ids in lists(part.column(at))]
                given = [c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*given, pa.array([x for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], schema=arrow)

    return rows.mapInArrow(run, schema)

