"""Words of UTF-8 texts as numpy arrays: spans, document numbers and 64-bit hashes.

A word class is a set of bytes.  All classes used here are ASCII classes, in
which every byte from 0x80 up is a word byte (or none is), so splitting bytes
equals splitting characters.  Lower-casing is that of A-Z only.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed in one step; a longer word is hashed in one piece.
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(outside: list[tuple[int, int]]) -> np.ndarray:
    """True for word bytes; ``outside`` lists the ranges (first, last) that are not."""
    out = np.ones(256, bool)
    for a, b in outside:
        out[a: b + 1] = False
    return out


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, letters and all beyond ASCII; A-Z counts, as it is lower-cased later.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word of the documents ``buf[offs[i]:offs[i + 1]]``."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, none
    w = inside[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    head, tail = offs[:-1][offs[:-1] < len(buf)], offs[1:][offs[1:] > 0] - 1
    first[head], last[tail] = w[head], w[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span; equal (lower-cased) bytes give equal hashes anywhere."""
    values, out, i = _byte_values(lower), np.empty(len(start), np.uint64), 0
    power = inverse = np.empty(0, np.uint64)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SEGMENT, side="right")))
        at, n = start[i], int(end[j - 1] - start[i])
        if n > len(power):
            power, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[buf[at: at + n]] * power[:n], out=sums[1:])
        out[i:j] = (sums[end[i:j] - at] - sums[start[i:j] - at]) * inverse[start[i:j] - at]
        i = j
    return mix(out ^ mix((end - start).astype(np.uint64)))


def pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each two neighbouring words of one document."""
    at = np.flatnonzero(doc[1:] == doc[:-1])
    return mix(h[at] * np.uint64(0xFF51AFD7ED558CCD) + mix(h[at + 1])), at
