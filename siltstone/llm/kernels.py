"""Vectorised text kernels over UTF-8 bytes: words, polynomial hashes, repeated windows.

A span's hash is sum(T[byte] * B**(i - start)) mod 2**64 with a random odd B and a random value for each
byte, put through a bijective mixer. Equal spans have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_INV = pow(_BASE, -1, 1 << 64)
_SEQ = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case with ASCII marks as space, for comparisons that disregard punctuation.
PLAIN = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        PLAIN[_b] = 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = np.full(size, _U(base), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers.clear() if len(_powers) > 3 else None
        _powers[base] = have
    return have[:n]


class Spans:
    """Hashes of any spans [start, end) of `data`."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, max(1, len(data)))[: len(data)], out=self.sums[1:])
        self.inverse = powers(_INV, len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without white space, and n+1 indices of each text's first word."""
    return runs(~SPACE[data], offs)


def runs(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes within a text, and n+1 indices of each text's first run."""
    first = np.zeros(len(solid) + 1, bool)
    first[offs] = True
    before = np.zeros(len(solid), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.zeros(len(solid), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def owner(firsts: np.ndarray) -> np.ndarray:
    """The text of each item, from the n+1 indices of the first items."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def windows(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start item and hash of each run of n items that lies in one text."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * _SEQ[j]
    last = np.repeat(firsts[1:], np.diff(firsts))
    at = np.flatnonzero(np.arange(m) + n <= last[:m])
    return at, mix(total[at] + _U(n))


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text: sorted hashes, and n+1 offsets of the texts.

    A text with 1 to n-1 words has its whole sequence as one shingle; without words it has none.
    """
    starts, ends, firsts = word_bounds(data, offs)
    words = Spans(data).hash(starts, ends)
    at, value = windows(words, firsts, n)
    text = owner(firsts)
    doc = text[at]
    count = np.diff(firsts)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = count[short] > j
            extra[has] += words[firsts[short[has]] + j] * _SEQ[j]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(extra + count[short].astype(np.uint64))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(len(offs)))


def repeated(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each (doc, value) occurs, for each item."""
    key = mix(value ^ mix(doc.astype(np.uint64) + _U(1)))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inverse]


def per_text(items: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise mask or count over each text."""
    total = np.zeros(len(items) + 1, np.int64)
    np.cumsum(items, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
