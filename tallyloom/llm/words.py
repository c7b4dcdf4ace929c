"""Hashes of words and of word shingles for a batch of texts at once, with numpy."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: A random number for each byte value, A-Z as a-z, and 0 for white space (space, 9 to 13).
_OF_BYTE = _table(256, 7)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_OF_BYTE[_SPACE] = 0
#: An odd base of the polynomial hash and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each with a space behind it, as one array of bytes; then for each word of all texts
    a 64-bit hash, A-Z lower-cased, its start and its end in that array; then where each text's words
    begin (and the last end).

    A word is a run of bytes other than ASCII white space.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))  # starts and ends in turn
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths + 1))))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_OF_BYTE[buf] * _powers(_BASE, len(buf)))))
    sums = (total[ends] - total[starts]) * _powers(_INVERSE, len(buf) + 1)[starts]
    return buf, mix64(sums + (ends - starts).astype(np.uint64)), starts, ends, bounds


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and the bounds of word_spans."""
    _, words, _, _, bounds = word_spans(texts)
    return words, bounds


def prefix_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each run of words from first up to end."""
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * _powers(_BASE, len(words)))))
    sums = (total[end] - total[first]) * _powers(_INVERSE, len(words) + 1)[first]
    return mix64(sums + (end - first).astype(np.uint64))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of fewer words, the whole sequence is one; of none, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    if k < n:
        out = mix64(out + np.uint64(k))
    return np.unique(out)
