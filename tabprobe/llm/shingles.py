"""Word shingle sets and minhash signatures of text batches, vectorised."""

from __future__ import annotations

import numpy as np

from tabprobe.llm.common import LOWER_TABLE, mix64, span_hashes, words_of

_MULT = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``width``-word shingles of each row, sorted, and the n + 1 offsets of the rows.

    Texts are lower-cased in A-Z, words are ``[^\\x20\\x09-\\x0D]+``. With fewer words the whole sequence is one shingle.
    """
    data = LOWER_TABLE[data]
    starts, stops, first = words_of(data, off)
    word = span_hashes(data, starts, stops)
    n_words = np.diff(first)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    at = first[:-1][row] + np.arange(len(row)) - (ends - counts)[row]  # the first word of each shingle
    h = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = at + k < first[1:][row]
            part = np.zeros(len(row), np.uint64)
            part[there] = word[at[there] + k] + np.uint64(1)
            h = mix64(h * _MULT[k % 5] + part + np.uint64(k + 1))
    order = np.lexsort((h, row)) if len(row) else np.zeros(0, np.int64)
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(off)))


def signatures(h: np.ndarray, off: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Minhash signatures (rows x ``size``, uint32); rows without shingles have all ones."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 2**32, size, dtype=np.uint32)
    mult = rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    n = len(off) - 1
    out = np.full((n, size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full) == 0:
        return out
    low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    begins = off[:-1][full]
    with np.errstate(over="ignore"):
        for k in range(size):
            x = (low ^ flip[k]) * mult[k]
            x ^= x >> np.uint32(15)
            x = (x + high) * (mult[k] ^ np.uint32(0x2C1B3C6C))
            out[full, k] = np.minimum.reduceat(x, begins)
    return out


def set_keys(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that depend on a row's set only."""
    n = len(off) - 1
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            a[full] = np.add.reduceat(mix64(h ^ _MULT[0]), off[:-1][full])
            b[full] = np.add.reduceat(mix64(h ^ _MULT[1]), off[:-1][full])
    return a.view(np.int64), b.view(np.int64)
