"""Words of whole texts as numpy arrays: byte spans and 64-bit hashes, many texts at a time.

A word is a run of ASCII digits, ASCII letters (A-Z count as a-z) and any non-ASCII characters, so spans can be found on
UTF-8 bytes. Hashes are polynomials modulo 2^64 of per-byte random values, followed by a finaliser.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x41:0x5B] = IN_WORD[0x80:] = True
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


BYTE = randoms(256, 11)[LOWER]
BASE = int(randoms(1, 12)[0] | U(1))


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWER = powers(4096)


@dataclass
class Words:
    hashes: np.ndarray  # of every word
    starts: np.ndarray  # its first byte
    ends: np.ndarray  # one past its last
    first: np.ndarray  # number of words before each text, and in all


def split(data: np.ndarray, offs: np.ndarray) -> Words:
    """Words of the texts that lie end to end in data; none spans two texts."""
    inside = IN_WORD[data]
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(offs), np.int64))
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    new[heads] = inside[heads]
    starts = np.flatnonzero(new)
    kept = LOWER[data[inside]]
    before = np.cumsum(inside, dtype=np.int64)[starts] - 1
    lengths = np.diff(np.append(before, len(kept)))
    place = np.arange(len(kept)) - np.repeat(before, lengths)
    longest = int(lengths.max())
    power = POWER if longest <= len(POWER) else powers(longest)
    hashes = np.add.reduceat(BYTE[kept] * power[place], before)
    return Words(mix(hashes ^ lengths.astype(np.uint64)), starts, starts + lengths, np.searchsorted(starts, offs))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and the number of runs before each text. A text with fewer words, but not
    none, has one run of all its words."""
    n = np.diff(words.first)
    total = len(words.hashes)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    factor = randoms(size, 13) | U(1)
    run = np.zeros(total, np.uint64)
    for k in range(size):
        run[: total - k] += words.hashes[k:] * factor[k]
    keep = np.ones(total, bool)
    for k in range(1, size):
        tail = words.first[1:][n >= k] - k
        keep[tail] = False
    counts = np.maximum(n - size + 1, 0)
    for i in np.flatnonzero((n > 0) & (n < size)):
        a, b = words.first[i], words.first[i + 1]
        run[a] = (words.hashes[a:b] * factor[: b - a]).sum() + U(b - a)
        keep[a] = True
        counts[i] = 1
    return mix(run[keep]), np.concatenate([[0], np.cumsum(counts)])
