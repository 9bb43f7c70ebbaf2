"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct shingles of ``width`` words. ``bands`` x ``rows``
minima of the set are taken; the rows of a band, hashed together, make a bucket,
and documents that share a bucket are candidates. Of each minimum only the low
``bits`` bits are kept, packed into one signature: for a candidate pair the share
of equal fields, less the share 2**-bits that agree by chance, estimates the
similarity by bit counts. Pairs whose estimate is not six standard deviations
below the threshold are confirmed on the full sets.

A pair at the threshold of 0.8 misses all of 40 bands of 4 rows with probability
7e-10, so that in effect no link is lost.

How Spark runs it. Rows with equal sets become one representative, the least of their
rows, which stands for the set whatever its doc_ids are. Then, in
each bucket, all members are compared with its smallest one, never with each
other, and confirmed links are joined to components. Only members of a bucket
that still lie in different components are compared with one another, in blocks
of ``block`` members; blocks go to different tasks. They emit a pair in the first
of the buckets that it shares, and only if its estimate passes and so does a bound
that loses no link: each document has a bitmap of its hashed set, and bits in which
two bitmaps differ are no more than the elements in which the sets do. Sets are
recomputed from the text for the documents in candidate pairs alone.

Defined cases: texts without words, or null, have an empty set and are linked
with nothing; a text shorter than a shingle has its whole word sequence as its
only one; rows of one doc_id count as one document; a row without doc_id is
linked with nothing, its component is null and it is kept; an empty table gives
no rows; other columns stay as they are in ``drop_near_duplicates`` and are
ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import storage
from ..operators.components import connected_components
from . import words
from .rows import map_texts

_random = np.random.Generator(np.random.PCG64(7))
MOST = 512
#: Bytes of text whose sets are made together.
PIECE = 500_000
SCALE = _random.integers(1, 2**63, MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _random.integers(1, 2**63, MOST, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    hashed, counts = words.word_hashes(texts)
    n = len(hashed)
    rolled = hashed.copy()
    for j in range(1, width):
        rolled[: n - j] = rolled[: n - j] * STEP + hashed[j:]
    rolled = words.mix(rolled + np.uint64(width))
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            whole = hashed[at]
            for h in hashed[at + 1 : at + c]:
                whole = words.mix(np.array([whole], np.uint64))[0] + h
            out.append(words.mix(np.array([whole], np.uint64) + np.uint64(1000 + c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k minima of each set, none of which may be empty."""
    out = np.empty((len(sets), k), np.uint64)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= 60_000):
            size, end = size + len(sets[end]), end + 1
        joined = np.concatenate(sets[start:end])
        firsts = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
        work = np.empty_like(joined)
        for i in range(k):
            np.multiply(joined, SCALE[i], out=work)
            np.add(work, SHIFT[i], out=work)
            out[start:end, i] = np.minimum.reduceat(work, firsts)
        start = end
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = values.reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), v.shape[:2]).copy()
    for r in range(rows):
        key = words.mix(key * STEP + v[:, :, r])
    return key.view(np.int64)


def packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each minimum, packed into 64-bit words."""
    fields = 64 // bits
    n, k = values.shape
    low = np.zeros((n, -(-k // fields) * fields), np.uint64)
    low[:, :k] = values & np.uint64((1 << bits) - 1)
    low = low.reshape(n, -1, fields) << (np.arange(fields, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(low, axis=2)


def similarity(a: np.ndarray, b: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Collision-corrected estimates from packed signatures (last axis: words)."""
    x = a ^ b
    step = 1
    while step < bits:  # gathers each field's bits in its lowest
        x = x | (x >> np.uint64(step))
        step *= 2
    unequal = np.bitwise_count(x & np.uint64(sum(1 << i for i in range(0, 64, bits)))).sum(-1, dtype=np.int64)
    chance = 2.0**-bits
    return ((k - unequal) / k - chance) / (1 - chance)


def floor_of(threshold: float, k: int, bits: int) -> float:
    """Six standard deviations of the estimate below the threshold."""
    chance = 2.0**-bits
    c = threshold + (1 - threshold) * chance
    return threshold - 6 * (c * (1 - c) / k) ** 0.5 / (1 - chance)


def bitmap(items: np.ndarray) -> bytes:
    """A bit for each hash modulo a power of two, 8 to 16 bits for each element."""
    size = 1 << max(6, (8 * len(items) - 1).bit_length())
    flags = np.zeros(size, bool)
    flags[(items & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) of half or less the size."""
    return maps if maps.shape[1] == width else np.bitwise_or.reduce(maps.reshape(len(maps), -1, width), axis=1)


class Members:
    """Members of a bucket, or of two of its blocks, and which pairs of them may be links."""

    def __init__(self, group: pd.DataFrame, k: int, bits: int, least: float, threshold: tuple[int, int]) -> None:
        self.ids, self.component, self.n = group["id"].to_numpy(), group["component"].to_numpy(), group["n_shingles"].to_numpy()
        self.sigs = np.frombuffer(b"".join(group["sig"]), np.uint64).reshape(len(group), -1)
        self.keys = np.stack(group["buckets"].to_numpy())
        self.bucket, self.own = group["bucket"].iloc[0], group["own"].to_numpy()
        width = np.array([len(x) for x in group["bits"]])
        self.width, self.row, self.maps = width, np.zeros(len(group), np.int64), {}
        for w in np.unique(width).tolist():
            some = np.flatnonzero(width == w)
            self.row[some] = np.arange(len(some))
            self.maps[w] = np.frombuffer(b"".join(group["bits"].iloc[some]), np.uint8).reshape(len(some), w)
        self.k, self.bits, self.least, self.threshold = k, bits, least, threshold

    def near(self, x: int, y: np.ndarray) -> np.ndarray:
        """Those of the members y that may be linked with x and first meet it in this bucket."""
        t0, t1 = self.threshold
        n = self.n
        y = y[(self.component[y] != self.component[x]) & (t1 * np.minimum(n[x], n[y]) >= t0 * np.maximum(n[x], n[y]))]
        y = y[similarity(self.sigs[x], self.sigs[y], self.k, self.bits) >= self.least]
        if len(y):
            shared = self.keys[y] == self.keys[x]
            y = y[self.keys[x][shared.argmax(1)] == self.bucket]
        out = []
        for w in np.unique(self.width[y]).tolist():
            some = y[self.width[y] == w]
            least = min(w, self.width[x])
            a, b = folded(self.maps[self.width[x]][self.row[x]][None], least), folded(self.maps[w][self.row[some]], least)
            differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            out.append(some[differ * (t1 + t0) <= (n[x] + n[some]) * (t1 - t0)])
        return np.concatenate(out) if out else y

    def pairs(self, i: int, j: int) -> pd.DataFrame:
        left, right = np.flatnonzero(self.own == i), np.flatnonzero(self.own == j)
        out = []
        for x in left.tolist():
            y = self.near(x, right if i != j else right[self.ids[right] > self.ids[x]])
            out.append(np.c_[np.minimum(self.ids[x], self.ids[y]), np.maximum(self.ids[x], self.ids[y])])
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), self.ids.dtype), columns=["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 4, bits: int = 4, block: int = 1024) -> DataFrame:
    """Links documents whose sets have threshold[1] * intersection >= threshold[0] * union.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach),
    kept (doc_id = component_id), a row for each row of docs.
    """
    if bits not in (1, 2, 4, 8) or bands * rows > MOST:
        raise ValueError(f"bits must be 1, 2, 4 or 8, and bands * rows {MOST} at most")
    k, least = bands * rows, floor_of(threshold[0] / threshold[1], bands * rows, bits)
    text = F.coalesce("text", F.lit(""))
    by_text = F.struct("doc_id", F.xxhash64(text).alias("text_hash")).alias("doc")

    def sign(batch: list[bytes]) -> dict:
        sets = shingle_sets(batch, width)
        some = [i for i, s in enumerate(sets) if len(s)]
        values = minima([sets[i] for i in some], k)
        keys, sigs = band_keys(values, bands, rows), packed_bits(values, bits)
        row = dict(zip(some, range(len(some)), strict=True))
        return {
            "n_shingles": [len(s) for s in sets],
            "set_a": [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
            "set_b": [int(words.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
            "buckets": [keys[row[i]] if i in row else None for i in range(len(sets))],
            "sig": [sigs[row[i]].tobytes() if i in row else None for i in range(len(sets))],
            "bits": [bitmap(s) if len(s) else None for s in sets],
        }

    found_sets = map_texts(docs.select(by_text, "text"), sign, "n_shingles long, set_a long, set_b long, buckets array<long>, sig binary, bits binary", as_bytes=True, key="doc")
    signed = storage.saved(found_sets.select("doc.*", "n_shingles", "set_a", "set_b", "buckets", "sig", "bits", F.monotonically_increasing_id().alias("row")), "signed")
    # rows that repeat a text under one doc_id, to read that text once
    repeated = storage.saved(signed.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash"), "repeated")
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    if not repeated.isEmpty():
        texts = texts.join(repeated, ["doc_id", "text_hash"], "left_anti").unionByName(texts.join(repeated, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    linkable = signed.where("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    # a set's id is its least row
    firsts = storage.saved(linkable.groupBy(*same).agg(F.min("doc_id").alias("first"), F.min("row").alias("id")), "sets")
    chosen = linkable.join(firsts.select(F.col("id").alias("row")), "row", "left_semi")
    members = storage.saved(chosen.select(F.explode("buckets").alias("bucket"), F.col("row").alias("id")), "buckets")
    sizes = members.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("members")).where("centre <> last")
    sizes = storage.saved(sizes, "bucket-sizes")
    star = storage.saved(members.join(sizes, "bucket").where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs that their sizes and the estimate of their packed signatures allow to be links."""

        def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x, y = (np.frombuffer(b"".join(frame[c]), np.uint64).reshape(len(frame), -1) for c in ("sig_a", "sig_b"))
                    yield frame.loc[similarity(x, y, k, bits) >= least, ["a", "b"]]

        side = lambda c: signed.where("sig is not null").select(F.col("row").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(threshold[1] * F.least("n_a", "n_b") >= threshold[0] * F.greatest("n_a", "n_b"))
        return storage.saved(both.select("a", "b", "sig_a", "sig_b").mapInPandas(judge, "a long, b long"), "plausible")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The plausible ones of the pairs of which the full sets are similar. A set travels to the first
        member of its pairs, and with each pair to the second."""
        pairs = plausible(pairs)
        taking_part = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()

        def with_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = list(frame["text"])
                for start, end in words.blocks(texts, PIECE):
                    yield pd.DataFrame({"row": frame["row"].iloc[start:end], "items": [s.tobytes() for s in shingle_sets(texts[start:end], width)]})

        needed = signed.select("doc_id", "text_hash", "row").where("n_shingles > 0").join(taking_part, "row", "left_semi")
        sets = storage.saved(texts.join(needed, ["doc_id", "text_hash"]).select("row", "text").mapInPandas(with_sets, "row long, items binary"), "sets")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(threshold[1] * shared >= threshold[0] * (len(s) + len(t) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        side = lambda c: sets.select(F.col("row").alias(c), F.col("items").alias(f"items_{c}"))
        found = storage.saved(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "items_a", "items_b").mapInArrow(compare, "a long, b long"), "links")
        storage.discard(sets, pairs)
        return found

    links = confirmed(star)
    labels = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # members of a bucket that lie in different components still
    placed = members.join(sizes.select("bucket", "members"), "bucket").join(labels.withColumnRenamed("node", "id"), "id", "left")
    placed = storage.saved(placed.select("bucket", "members", "id", F.coalesce("component", "id").alias("component")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    n = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    open_members = placed.join(mixed, "bucket", "left_semi").select("bucket", "id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    shown = signed.select(F.col("row").alias("id"), "n_shingles", "buckets", "sig", "bits").where("sig is not null")
    open_members = open_members.join(shown, "id").select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n_shingles", "buckets", "sig", "bits")

    def cross(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            key = frame[["bucket", "i", "j"]].to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1 if len(key) else np.empty(0, np.int64)
            held = frame.iloc[change[-1] :] if len(change) else frame
            bounds = [0, *change.tolist()]
            yield from (found(frame.iloc[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))
        if held is not None and len(held):
            yield found(held)

    def found(group: pd.DataFrame) -> pd.DataFrame:
        return Members(group, k, bits, least, threshold).pairs(group["i"].iloc[0], group["j"].iloc[0])

    sorted_members = open_members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    rest = sorted_members.mapInPandas(cross, "a long, b long").distinct().join(star, ["a", "b"], "left_anti")
    rest = storage.saved(rest, "pairs")
    storage.discard(members, sizes, star, placed)
    if not rest.isEmpty():
        more = confirmed(rest)
        if not more.isEmpty():
            joined = more.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
            joined = joined.select(F.coalesce("x", "a").alias("src"), F.coalesce("y", "b").alias("dst"))
            over = connected_components(joined)
            nodes = labels.select("node", F.col("component").alias("node_of")).unionByName(over.select("node", F.col("node").alias("node_of")))
            labels = nodes.join(over.select(F.col("node").alias("node_of"), "component"), "node_of", "left").groupBy("node").agg(F.min(F.coalesce("component", "node_of")).alias("component"))

    # a document's component: that of its sets; a doc_id that has several sets joins them
    of_set = firsts.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select(*same, "first", F.coalesce("component", "id").alias("part"))
    doc_parts = storage.saved(linkable.select("doc_id", *same).join(of_set, same).select("doc_id", "part"), "parts")
    of_doc = doc_parts.groupBy("doc_id").agg(F.min("part").alias("part"), F.max("part").alias("last"))
    joining = storage.saved(doc_parts.join(of_doc.where("part <> last").select("doc_id", F.col("part").alias("src")), "doc_id").select("src", F.col("part").alias("dst")).where("src <> dst").distinct(), "joining")
    least = of_doc.groupBy("part").agg(F.min("doc_id").alias("component"))
    if not joining.isEmpty():
        over = connected_components(joining).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        of_doc = of_doc.join(over, "part", "left").select("doc_id", F.coalesce("whole", "part").alias("part"))
        least = of_doc.groupBy("part").agg(F.min("doc_id").alias("component"))
    of_doc = of_doc.select("doc_id", "part").join(least, "part").select("doc_id", "component")
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, one row for each doc_id, with all their columns.
    Of rows that repeat a doc_id the one with the least text stays (of equal texts, that with the
    least other columns, as JSON); rows without doc_id stay."""
    found = near_duplicates(docs, **options)
    kept = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("copies"))
    kept = storage.saved(kept.where("kept"), "kept")
    one = docs.join(kept.where("copies = 1").select("doc_id"), "doc_id", "left_semi")
    if not kept.where("copies > 1").isEmpty():
        repeated = docs.join(kept.where("copies > 1").select("doc_id"), "doc_id", "left_semi")
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        order = F.struct(F.col("text"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit(""))
        chosen = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("row"))
        one = one.unionByName(chosen.select("row.*"))
    return one.unionByName(docs.where("doc_id is null"))
