"""Language-model scoring by prediction by partial matching (PPM).

A byte-context trie of maximum order K is learned from the training documents:
for every context of 0..K bytes it holds how often each next byte followed. The
code length of a byte follows the longest context that was seen; a byte that the
context lacks is coded by an escape (method D: a context of T occurrences and n
distinct symbols gives (2c-1)/2T to a symbol and n/2T to the escape) to the next
shorter context, from which the symbols of the longer one are excluded. Below
order 0 all symbols that are left are equally likely. A text is preceded by K
start bytes 0xFE and followed by one end byte 0xFF, neither of which UTF-8 uses,
so that the probabilities of all texts add up to at most one.

How Spark runs it. The trie grows with the corpus and is never broadcast.
Documents are dealt into groups of about ``group_bytes`` by a hash of their id, and
shuffled as compressed blocks of the documents of one batch and group; a group names its distinct (K+1)-grams once, each with its count in training texts.
Counts are summed by gram (rows of a gram: at most one a group); the trie below a
context of order 2 is then evaluated in one task, or, if it has more than a thousandth
of all distinct grams, in several by the byte before, each of which gets the counts that
follow the context of order 2. That turns each distinct gram
into its log probability; these go back to the groups that asked by an equi-join
on the gram, and each group adds them up over its documents. Only counts by
byte pairs (65,536 rows at most) pass through the driver. Words of the unigram
base travel the same way, as hashes of 62 bits.

Defined cases: null text is an empty one (only the end byte is coded); repeated
rows are scored each; a text of any length is scored whole; an empty table gives no rows; a
model learned from nothing gives each byte 1/256; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame, functions as F

from .. import storage
from . import words

START, END = 0xFE, 0xFF
#: Keys of words have this bit, which no gram of up to 7 bytes has, and are hashes of 62 bits else.
WORD = 1 << 62


def position_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order+1)-gram that ends at each byte and end byte, packed big-endian,
    and the number of them that each text has."""
    pad = bytes([START]) * order
    data = np.frombuffer(b"".join([p for t in texts for p in (pad, t, bytes([END]))]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    grams = np.zeros(max(0, len(data) - order), np.int64)
    for j in range(order + 1):
        grams <<= 8
        grams |= data[j : len(data) - order + j]
    if order and len(texts) > 1:  # windows that would reach over two texts end in a pad
        last = np.cumsum(sizes + order)
        keep = np.ones(len(grams), bool)
        for j in range(order):
            keep[last[:-1] - order + j] = False
        grams = grams[keep]
    return grams, sizes


class Counter64:
    """Counts of 64-bit keys, added in blocks."""

    def __init__(self) -> None:
        self.keys, self.counts, self.parts, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray | int = 1) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts * weights))
        self.waiting += len(found)
        if self.waiting > max(500_000, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
            counts = np.concatenate([self.counts, *(c for _, c in self.parts)])
            by = np.argsort(keys, kind="stable")
            keys, counts = keys[by], counts[by]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
            self.parts, self.waiting = [], 0
        return self.keys, self.counts


def gram_logs(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int, triples: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of the last byte of each distinct gram after the bytes before it.

    ``grams`` holds all grams, seen in training or asked for, that share the
    contexts of order 2 it has, ``counts`` their training counts; ``pairs`` (256 x 256)
    counts the byte pairs of all training texts. Of a context of order 2 that ``triples``
    (byte triples and their counts in all training texts) has, it may hold only all grams
    that share the contexts of order 3 it has.
    """
    seen = counts > 0
    result, done, escaped = np.zeros(len(grams)), np.zeros(len(grams), bool), np.zeros(len(grams), bool)
    excluded_sum, excluded_n = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    level = {}
    for j in range(order, -1, -1):
        if j >= 2 or j == order:
            masked = grams[seen] & ((1 << 8 * (j + 1)) - 1)
            keys, back = np.unique(masked, return_inverse=True)
            sums = np.bincount(back, counts[seen], len(keys)).astype(np.int64)
            if j == 2 and triples is not None:
                own = ~np.isin(keys >> 8, triples[0] >> 8)
                keys, sums = np.r_[keys[own], triples[0]], np.r_[sums[own], triples[1]]
                by = np.argsort(keys)
                keys, sums = keys[by], sums[by]
        else:
            table = pairs.ravel() if j == 1 else pairs.sum(0)
            keys = np.flatnonzero(table)
            sums = table[keys].astype(np.int64)
        level[j] = keys, sums

    def find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        return at, (keys[at] == asked) if len(keys) else np.zeros(len(asked), bool)

    for j in range(order, -1, -1):
        keys, sums = level[j]
        contexts, back = np.unique(keys >> 8, return_inverse=True)
        total = np.bincount(back, sums, len(contexts)).astype(np.int64)
        distinct = np.bincount(back, minlength=len(contexts))
        at, known = find(contexts, (grams & ((1 << 8 * (j + 1)) - 1)) >> 8)
        where = np.flatnonzero(known & ~done)
        here = at[where]
        t = total[here] - excluded_sum[where]
        n = distinct[here] - excluded_n[where]
        some = n > 0
        where, here, t, n = where[some], here[some], t[some], n[some]
        g, hit = find(keys, grams[where] & ((1 << 8 * (j + 1)) - 1))
        c = np.where(hit, sums[g] if len(keys) else 0, 0)
        result[where] += np.log10(np.where(hit, 2 * c - 1, n) / (2.0 * t))
        done[where[hit]] = True
        if j:
            below, below_sums = level[j - 1]
            suffix, _ = find(below, keys & ((1 << 8 * j) - 1))
            covered = np.bincount(back, below_sums[suffix] if len(keys) else None, len(contexts)).astype(np.int64)
            left = np.flatnonzero(known & ~done)
            excluded_sum[left], excluded_n[left] = covered[at[left]], distinct[at[left]]
        else:
            left = np.flatnonzero(~done)
            result[left] -= np.log10(256 - len(keys))
    return result


class Lookup:
    """Values by 64-bit key: a few hash tables, each for the keys that found no slot before."""

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.tables = keys, values, []
        left = np.arange(len(keys), dtype=np.int32)
        for factor in self.FACTORS:
            if not len(left):
                break
            bits = max(4, int(2 * len(left)).bit_length())
            table = np.zeros(1 << bits, np.int32)
            slot = self.slots(keys[left], factor, bits)
            table[slot] = left
            self.tables.append((factor, bits, table))
            left = left[table[slot] != left]
        self.rest = np.sort(keys[left])
        self.rest_values = values[left][np.argsort(keys[left])]

    @staticmethod
    def slots(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """All keys asked for must be there."""
        out, where = np.empty(len(asked)), None
        for factor, bits, table in self.tables:
            at = table[self.slots(asked, factor, bits)]
            hit = self.keys[at] == asked
            if where is None:
                out[:] = self.values[at]
                where = np.flatnonzero(~hit)
            else:
                out[where[hit]] = self.values[at[hit]]
                where = where[~hit]
            asked = asked[~hit]
            if not len(asked):
                return out
        if where is None:
            where = np.arange(len(asked))
        out[where] = self.rest_values[np.searchsorted(self.rest, asked)]
        return out


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashed, counts = words.word_hashes(texts, lower=False)
    return (hashed >> np.uint64(2)).view(np.int64) | WORD, counts


def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a group as last column, as one compressed block for each batch and group."""
    for batch in batches:
        order = pa.compute.sort_indices(batch.column("grp"))
        batch = batch.take(order)
        groups = batch.column("grp").to_numpy()
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)
        blocks = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(groups)], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(a, b - a))
            blocks.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(groups[first], pa.int32()), pa.array(blocks, pa.binary())], ["grp", "block"])


def score_documents(docs: DataFrame, learn, order: int = 5, group_bytes: int = 20 << 20, lower: bool = True, least_split: int = 5000) -> DataFrame:
    """Scores every text by a PPM model of the rows for which ``learn`` holds.

    docs: doc_id and text; order: 2 to 6 context bytes; lower: lower-case A-Z first.
    Returns doc_id, learned, n_bytes, n_tokens, n_known, train_tokens, base_score
    (unigram words with one end token a text, add-one smoothed, log10) and score
    (the model's log10 probability of the bytes and the end).
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = storage.parts(size, group_bytes)
    dealt = rows.select("doc_id", "text", "learned", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("grp")).mapInArrow(pressed, "grp int, block binary")
    fold = bytes(words.LOWER) if lower else None

    def opened(table: pa.Table) -> Iterator[tuple[list, list[bytes], list[bool]]]:
        """Ids, texts and flags of each block of a group."""
        for block in table.column("block"):
            part = pa.ipc.open_stream(block.as_buffer()).read_all()
            texts = part.column(1).to_pylist()
            yield part.column(0).to_pylist(), [t.translate(fold) for t in texts] if fold else texts, part.column(2).to_pylist()

    def name_keys(table: pa.Table) -> pa.Table:
        counter = Counter64()
        for _, texts, flags in opened(table):
            for learned in (True, False):
                some = [t for t, x in zip(texts, flags, strict=True) if x == learned]
                for a, b in words.blocks(some, 1_000_000):
                    counter.add(position_grams(some[a:b], order)[0], int(learned))
                    counter.add(word_keys(some[a:b])[0], int(learned))
        keys, counts = counter.settle()
        return pa.table({"grp": pa.array(np.full(len(keys), table.column("grp")[0].as_py()), pa.int32()), "key": keys, "n": counts})

    named = storage.saved(dealt.groupBy("grp").applyInArrow(name_keys, "grp int, key long, n long"), "ppm-named")
    totals = storage.saved(named.groupBy("key").agg(F.sum("n").alias("n")), "ppm-totals")
    grams, of_words = totals.where(F.col("key") < WORD), totals.where(F.col("key") >= WORD)
    pairs = np.zeros((256, 256), np.int64)
    for pair, n in grams.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n")).collect():  # 65,536 rows at most
        pairs[pair >> 8, pair & 255] = n
    n_words, n_distinct = of_words.where("n > 0").agg(F.sum("n"), F.count("*")).first()
    ends = rows.where("learned").count()
    n_train, n_distinct = (n_words or 0) + ends, n_distinct + (ends > 0)

    def evaluate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if got := [f for f in frames if len(f)]:
            keys, n, triple = (np.concatenate([f[c] for f in got]) for c in ("key", "n", "triple"))
            given, at = np.unique(keys[triple], return_index=True)  # one for each split that came here
            logs = gram_logs(keys[~triple], n[~triple], pairs, order, (given, n[triple][at]))
            keys = keys[~triple]
            for i in range(0, len(keys), 100_000):
                yield pd.DataFrame({"key": keys[i : i + 100_000], "value": logs[i : i + 100_000]})

    # contexts of two bytes that have more than a thousandth of all grams are split by the byte before
    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sizes = grams.groupBy(context.alias("context")).count().collect() if order > 2 else []  # 65,536 rows at most
    most = max(least_split, sum(n for _, n in sizes) // 1000)
    large = docs.sparkSession.createDataFrame([(c, -(-n // most)) for c, n in sizes if n > most], "context int, splits long")  # below 1,000 rows where it is by the share
    marked = grams.withColumn("context", context).join(F.broadcast(large), "context", "left")
    dealt_grams = marked.select("key", "n", F.lit(False).alias("triple"), "context", F.coalesce(F.pmod(F.shiftright("key", 24).bitwiseAND(F.lit(0xFF)), "splits"), F.lit(0)).alias("split"))
    triples = marked.where("splits is not null and n > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key"), "context", "splits").agg(F.sum("n").alias("n"))
    triples = triples.select("key", "n", F.lit(True).alias("triple"), "context", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"))
    logs = dealt_grams.unionByName(triples).repartition("context", "split").select("key", "n", "triple").mapInPandas(evaluate, "key long, value double")
    values = logs.unionByName(of_words.select("key", F.col("n").cast("double").alias("value")))
    answers = named.select("grp", "key").join(values, "key").select("grp", "key", "value")

    def add_up(group: pa.Table, got: pa.Table) -> pa.Table:
        value_of = Lookup(got.column("key").to_numpy(), got.column("value").to_numpy())
        out = []
        for ids, texts, flags in opened(group):
            for a, b in words.blocks(texts, 1_000_000):
                asked, sizes = position_grams(texts[a:b], order)
                score = np.add.reduceat(value_of(asked), np.cumsum(sizes) - sizes)
                asked, sizes = word_keys(texts[a:b])
                c = value_of(asked)
                logs, known = np.r_[0, np.cumsum(np.log10((c + 1) / (n_train + n_distinct + 1)))], np.r_[0, np.cumsum(c > 0)]
                last = np.cumsum(sizes)
                out.append(pa.table({
                    "doc_id": pa.array(ids[a:b], pa.string()), "learned": pa.array(flags[a:b], pa.bool_()), "n_bytes": np.array([len(t) for t in texts[a:b]], np.int64), "n_tokens": sizes + 1,
                    "n_known": known[last] - known[last - sizes] + int(ends > 0), "train_tokens": np.full(b - a, n_train, np.int64),
                    "base_score": logs[last] - logs[last - sizes] + np.log10((ends + 1) / (n_train + n_distinct + 1)), "score": score,
                }))
        return pa.concat_tables(out)

    scored = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(add_up, "doc_id string, learned boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
