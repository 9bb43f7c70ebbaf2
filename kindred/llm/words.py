"""Words of many texts at once, as 64-bit hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of a text's UTF-8
form; its hash is a polynomial over bytes mapped to fixed random odd numbers,
modulo 2**64, and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240229))
BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTOR = 0x5851F42D4C957F2D
INVERSE = pow(FACTOR, -1, 2**64)
#: Powers are taken within pieces of this many bytes, so that their table is small.
PIECE = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    have = _powers.get(factor)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0], done, step = 1, 1, factor
        while done < size:  # doubles
            out[done : 2 * done] = out[:done] * np.uint64(step)
            done, step = 2 * done, step * step % 2**64
        _powers[factor] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of each number over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def blocks(texts: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text has a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def spans(texts: list[bytes], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes; first and past-last byte of each word; number of words of each text."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = space[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) + 1
    counts = np.diff(np.r_[0, np.searchsorted(starts, bounds)]) if len(texts) else np.empty(0, np.int64)
    return data, starts, ends, counts


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the words at the places; bytes are read in pieces of ``PIECE``, so that little more than a number a word is held."""
    if not len(starts):
        return np.empty(0, np.uint64)
    values = BYTES[LOWER] if lower else BYTES
    n = len(data)
    at_start, at_end, inverse = (np.empty(len(starts), np.uint64) for _ in range(3))  # sums before the place; powers of the inverse
    before, power, unpower = 0, 1, 1
    step, unstep = pow(FACTOR, PIECE, 2**64), pow(INVERSE, PIECE, 2**64)
    for c in range(0, n, PIECE):
        size = min(PIECE, n - c)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[c : c + size]] * powers(FACTOR, size), out=sums[1:])
        for places, out in ((starts, at_start), (ends, at_end)):
            a, b = np.searchsorted(places, [c, c + size])
            out[a:b] = np.uint64(before) + sums[places[a:b] - c] * np.uint64(power)
            if places is starts:
                inverse[a:b] = powers(INVERSE, size)[places[a:b] - c] * np.uint64(unpower)
        before = (before + int(sums[-1]) * power) % 2**64
        power, unpower = power * step % 2**64, unpower * unstep % 2**64
    return mix((at_end - at_start) * inverse)


def word_hashes(texts: list[bytes], lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, in order, and the number of words of each text."""
    out = []
    for a, b in blocks(texts, 1_000_000):
        data, starts, ends, counts = spans(texts[a:b], space)
        out.append((hashes(data, starts, ends, lower), counts))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([h for h, _ in out]), np.concatenate([c for _, c in out])
