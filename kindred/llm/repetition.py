"""Quality rules on repetition inside a text, by suffix arrays over words.

Suffixes of each text are sorted by prefix doubling, many texts at once; the longest
common prefixes of neighbours are found by comparing hashes of runs, in lengths that
double and then halve, so that a few numbers a word are held whatever the repeats. A suffix's longest
repeat is the longer of its two prefixes, the value of the deepest LCP interval it
lies in, so that the union of the spans of all maximal repeated substrings of at
least ``least`` words is the union of these. A text fails when they cover more
than ``most_covered`` of the characters in its words or one is longer than ``most_longest`` words.
The limits are published ones: a tenth of the characters in repeated runs of ten words (the
repetition filters of Rae et al., 2021), and runs of 50 words (the length from which Lee et al., 2022, take a
substring for a copy). Both lie within what the base lets pass: it asks for half of the
words in repeated windows.

How Spark runs it: each text alone, without a shuffle, in the scan's partitions.

Defined cases: null text is an empty one; texts without words have no repeats;
repeated rows are judged each; an empty table gives no rows; a text of any length is
judged whole; measures that equal a limit pass; other columns are
ignored by ``repetition`` and kept by ``drop_repetitive``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import rows, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


class Runs:
    """Hashes of all runs of a sequence of numbers, from two sums over powers of a base modulo a prime."""

    PRIMES = (2_147_483_647, 2_147_483_629)
    BASES = (1_103_515_249, 1_812_433_253)

    def __init__(self, numbers: np.ndarray) -> None:
        self.parts = []
        n = len(numbers)
        for prime, base, shift in zip(self.PRIMES, self.BASES, (0, 31), strict=True):
            power = np.empty(n + 1, np.uint32)
            power[0], done, step = 1, 1, base
            while done <= n:  # doubles
                some = power[: min(done, n + 1 - done)].astype(np.uint64)
                power[done : done + len(some)] = some * np.uint64(step) % np.uint64(prime)
                done, step = 2 * done, step * step % prime
            sums, before = np.zeros(n + 1, np.uint32), 0
            for c in range(0, n, 1 << 18):  # sums of 2**18 numbers below 2**31 have room
                part = (numbers[c : c + (1 << 18)] >> np.uint64(shift) & np.uint64(0x7FFFFFFF)) % np.uint64(prime) * power[c : min(n, c + (1 << 18))] % np.uint64(prime)
                added = np.cumsum(part) + np.uint64(before)
                sums[c + 1 : c + 1 + len(part)] = added % np.uint64(prime)
                before = int(added[-1]) % prime
            self.parts.append((np.uint64(prime), power, sums))

    def equal(self, p: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the runs of these lengths from p and from q (p < q) are equal."""
        same = np.ones(len(p), bool)
        for prime, power, sums in self.parts:
            x = (sums[p + length] + prime - sums[p]) % prime * power[q - p] % prime
            same &= x == (sums[q + length] + prime - sums[q]) % prime
        return same


def suffix_order(tokens: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of each text (up to ``end`` of its words) in order, by prefix doubling, and which of
    them begin with a word that the one before in the order begins with too."""
    n = len(tokens)
    keys = words.mix(tokens + end.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    del keys
    repeated = ~new
    places = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, places, 0))
    open_places = places[~(new & np.r_[new[1:], True])]  # places in the order whose suffixes are not told apart yet
    step = 1
    while len(open_places):
        suffix = order[open_places]
        after = suffix.astype(np.int64) + step
        second = np.where(after < end[suffix], rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[suffix].astype(np.int64) * (n + 1) + second
        del after, second
        by = np.argsort(pair, kind="stable")
        suffix, pair = suffix[by], pair[by]
        new = np.r_[True, pair[1:] != pair[:-1]]
        del by, pair
        order[open_places] = suffix
        rank[suffix] = np.maximum.accumulate(np.where(new, open_places, 0))
        step *= 2
        open_places = open_places[~(new & np.r_[new[1:], True])]
    return order, repeated


def longest_repeats(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word of each text, the length of the longest substring that starts there
    and starts at another word of the text too."""
    n = len(tokens)
    out = np.zeros(n, np.int32)
    if not n:
        return out
    end = np.repeat(np.cumsum(counts), counts).astype(np.int32)
    order, repeated = suffix_order(tokens, end)
    place = np.flatnonzero(repeated)
    if not len(place):
        return out
    runs = Runs(tokens)
    for c in range(0, len(place), 1 << 18):  # common prefixes of neighbours in the order, the lengths of LCP intervals
        some = place[c : c + (1 << 18)]
        left, right = order[some - 1], order[some]
        p, q = np.minimum(left, right), np.maximum(left, right)
        common, room = np.ones(len(p), np.int64), (end[q] - q).astype(np.int64)
        step = 1
        near = np.arange(len(p))  # lengths double while runs agree ...
        while len(near := near[room[near] >= 2 * step]):
            near = near[runs.equal(p[near], q[near], np.full(len(near), 2 * step))]
            step *= 2
            common[near] = step
        while step:  # ... and are then halved to the last that do
            near = np.flatnonzero(common + step <= room)
            near = near[runs.equal(p[near], q[near], common[near] + step)]
            common[near] += step
            step //= 2
        np.maximum.at(out, left, common)
        np.maximum.at(out, right, common)
    return out


def covered(lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray | int = 1) -> np.ndarray:
    """Words of each text in the union of the spans that start at each word, or their weights."""
    n = len(lengths)
    reach = np.maximum.accumulate(np.where(lengths > 0, np.arange(n) + lengths, 0)) if n else lengths
    inside = np.r_[0, np.cumsum((reach > np.arange(n)) * weights)]
    last = np.cumsum(counts)
    return inside[last] - inside[last - counts]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    some = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
    return len(some) - len(set(some))


def measures(texts: list[bytes], least: int) -> pd.DataFrame:
    out = []
    for a, b in words.blocks(texts, 1_000_000):
        part = texts[a:b]
        data, starts, ends, counts = words.spans(part)
        lengths = longest_repeats(words.hashes(data, starts, ends, lower=False), counts)
        bounds = np.cumsum([1, *(len(t) + 1 for t in part)]).tolist()
        seen, symbols = (data & 0xC0 != 0x80) & ~words.SPACE[data], SYMBOLS[data]
        within = lambda flags: [np.count_nonzero(flags[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        begun = np.r_[0, np.cumsum(seen, dtype=np.int32)]
        chars, long = begun[ends] - begun[starts], np.where(lengths >= least, lengths, 0)
        padded = np.r_[lengths, 0]
        longest = np.where(counts > 0, np.maximum.reduceat(padded, np.minimum(np.cumsum(counts) - counts, len(lengths))), 0)
        out.append(pd.DataFrame({
            "n_words": counts, "word_chars": within(seen), "n_symbols": within(symbols), "n_dup_lines": [repeated_lines(t) for t in part],
            "n_repeat_words": covered(np.where(lengths >= 3, 3, 0), counts), "covered_words": covered(long, counts), "covered_chars": covered(long, counts, chars), "longest_repeat": longest,
        }))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def repetition(docs: DataFrame, least: int = 10, most_covered: float = 0.1, most_longest: int = 50) -> DataFrame:
    """Measures and verdict of every text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, covered_words, covered_chars, longest_repeat.
    """
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words covered_chars longest_repeat".split()
    found = rows.map_texts(docs, lambda texts: measures(texts, least), ", ".join(f"{x} long" for x in names), as_bytes=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("covered_chars") <= F.lit(most_covered) * F.col("word_chars")) & (F.col("longest_repeat") <= most_longest)
    return found.select("doc_id", *names[:5], failed.alias("base_failed"), (~failed & good).alias("kept"), *names[5:])


def drop_repetitive(docs: DataFrame, least: int = 10, most_covered: float = 0.1, most_longest: int = 50) -> DataFrame:
    """The rows of docs whose text ``repetition`` keeps, with all their columns."""

    def judge(texts: list[str | None]) -> list[bool]:
        m = measures([(t or "").encode() for t in texts], least)
        base = (m["n_words"] >= 50) & (100 * m["n_repeat_words"] <= 50 * m["n_words"])
        return (base & (m["covered_chars"] <= most_covered * m["word_chars"]) & (m["longest_repeat"] <= most_longest)).tolist()

    return rows.filter_texts(docs, judge)
