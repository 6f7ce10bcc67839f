"""Words and their hashes for many texts at once, in numpy.

A word is a run of bytes other than white space of ASCII (x09-x0D, x20), with A-Z in lower case.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64; grown when a longer text comes."""
    if len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, start and end of each word in them, and the first word of each text (and the end)."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return raw, starts, ends, np.searchsorted(starts, edges)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word: a polynomial of its bytes, mixed with its length."""
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_ROLL = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The distinct shingles of `size` words of each text, as sorted 64-bit hashes.

    A text of fewer words has its whole sequence as its one shingle, one without words an empty set.
    """
    raw, starts, ends, first = word_spans(texts)
    hashes = word_hashes(raw, starts, ends)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _ROLL + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= size:
            out.append(np.unique(rolled[i : j - size + 1]))
        elif j > i:
            whole = np.zeros(1, np.uint64)
            for h in hashes[i:j]:
                whole = whole * _ROLL + h
            out.append(mix(whole + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
