"""Vectorised word and window hashing over Arrow string buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Texts stay in
Arrow's contiguous UTF-8 buffer; numpy works on slices of whole documents, so
memory is bounded by ``CHUNK_BYTES`` plus the longest single document.

Hashes are 64-bit: random values of bytes, weighed by a random odd coefficient for
each of 256 places, summed and finalised; longer words are hashed by blocks of 256
bytes, the blocks' hashes by blocks of 256 again, and so on, so that no pattern of
bytes or blocks cancels whatever its length. Windows weigh their words' hashes the
same way. Two given unequal words or windows collide with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_HASH_BLOCK = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
#: Bytes of a block, and the coefficients of its places.
_BLOCK = 256
_PLACE = mix64(np.arange(5001, 5001 + _BLOCK, dtype=np.uint64) * _GOLD) | np.uint64(1)
_COEF = mix64(np.arange(1001, 1065, dtype=np.uint64) * _GOLD) | np.uint64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SAME = np.arange(256, dtype=np.uint8)


class Texts:
    """Whole documents of one slice: ``data`` bytes and ``off`` document offsets."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def __len__(self) -> int:
        return len(self.off) - 1


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, Texts) of consecutive slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and off[-1] > 0 else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, Texts(data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each document); ends are exclusive."""
    n = len(t.data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(t.off), np.int64)
    solid = ~SPACE[t.data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.logical_not(solid[:-1], out=edge[1:])
    first = t.off[:-1][t.off[:-1] < n]
    edge[first] = True
    starts = np.flatnonzero(solid & edge)
    edge[-1] = True
    np.logical_not(solid[1:], out=edge[:-1])
    edge[t.off[1:][t.off[1:] > 0] - 1] = True
    ends = np.flatnonzero(solid & edge) + 1
    return starts, ends, np.searchsorted(starts, t.off)


def _blocks(values: np.ndarray) -> np.ndarray:
    """The hash of values of any number: of blocks, then of the blocks' hashes."""
    while True:
        n = len(values)
        sums = np.add.reduceat(values * _PLACE[np.arange(n) % _BLOCK], np.arange(0, n, _BLOCK))
        if len(sums) == 1:
            return sums[0]
        values = mix64(sums)


def word_hashes(t: Texts, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word's bytes after the byte map ``fold``."""
    out = np.empty(len(starts), dtype=np.uint64)
    size = ends - starts
    long = size > _BLOCK
    for w in np.flatnonzero(long):
        out[w] = _blocks(_BYTE[fold[t.data[starts[w] : ends[w]]]]) + np.uint64(size[w])
    usual = np.flatnonzero(~long)
    reach = np.cumsum(size[usual])
    i = 0
    while i < len(usual):
        j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + _HASH_BLOCK, "right")))
        at_word = usual[i:j]
        lens = size[at_word]
        at = np.zeros(j - i, dtype=np.int64)
        np.cumsum(lens[:-1], out=at[1:])
        inner = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
        byte = fold[t.data[inner + np.repeat(starts[at_word], lens)]]
        out[at_word] = np.add.reduceat(_BYTE[byte] * _PLACE[inner], at) + lens.astype(np.uint64)
        i = j
    return mix64(out)


def windows(h: np.ndarray, word_off: np.ndarray, k: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, window offsets of each document) of k consecutive words.

    With ``whole_short`` a document of 1 to k-1 words has one window, its whole
    sequence; a document without words has none.
    """
    counts = np.diff(word_off)
    full = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k) if whole_short else np.zeros(len(counts), bool)
    n = full + short
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    at = np.arange(off[-1], dtype=np.int64) - np.repeat(off[:-1] - word_off[:-1], n)
    pad = np.concatenate([h, np.zeros(k, np.uint64)])
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc += pad[at + j] * _COEF[j]
    for d in np.flatnonzero(short):
        w = h[word_off[d] : word_off[d + 1]]
        acc[off[d]] = (w * _COEF[: len(w)]).sum(dtype=np.uint64) ^ _COEF[32 + len(w) % 32]
    return mix64(acc), off


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document and their offsets."""
    v = values.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a > 1:
            v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    firsts = off[:-1][np.diff(off) > 0]
    keep[firsts] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return v[keep], total[off]


def shingle_sets(t: Texts, k: int = 5, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct k-word shingle hashes, and offsets."""
    starts, ends, word_off = words(t)
    h, off = windows(word_hashes(t, starts, ends, fold), word_off, k)
    return distinct(h, off)
