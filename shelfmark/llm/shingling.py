"""Sets of word shingles as 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from ._shared import text_buffers

#: Text that is hashed at once, in bytes; a longer one by itself.
SLICE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Each hash with its bits spread over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_BYTE = _random(256, 1000)[_LOWER]
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, so many at least."""
    return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(data: np.ndarray, ends: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, their first bytes, number of words before each text): words, A-Z lower-cased, are what gaps,
    a flag for each byte, separate."""
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~gaps[data]
    border = np.zeros(n + 1, bool)
    border[ends] = True
    begin = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | border))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | border[1:])) + 1
    powers, inverse = _powers(1 << max(20, n.bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[:n])))
    h = (total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
    return mixed(h), begin, np.searchsorted(begin, ends)


def _numbered(h: np.ndarray) -> np.ndarray:
    """The hashes as a sorted set, in which a repeated hash has another value each time."""
    h = np.sort(h)
    again = np.append(False, h[1:] == h[:-1])
    if not again.any():
        return h
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    time = (np.arange(len(h)) - first).astype(np.uint64)
    return np.sort(np.where(again, mixed(h + time * np.uint64(_BASE)), h))


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int, repeats: bool = False) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle has make one shingle, no word makes none.

    With repeats, a shingle that is there again counts as another, so that what two sets share is what their counts share.
    """
    h, _, first = word_hashes(data, ends)
    many, factor = np.diff(first), _random(words + 1, 2000) | np.uint64(1)
    full = max(len(h) - words + 1, 0)
    g = np.zeros(full, np.uint64)
    for k in range(words):
        g += h[k : k + full] * factor[k]
    g = mixed(g)
    out = []
    for lo, n in zip(first[:-1].tolist(), many.tolist()):
        if n >= words:
            own = g[lo : lo + n - words + 1]
            out.append(_numbered(own) if repeats else np.unique(own))
        elif n:
            out.append(mixed((h[lo : lo + n] * factor[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n) * factor[words]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str):
    """(first row, rows after the last, bytes, offsets) of parts of a batch, of about a megabyte of text each."""
    data, ends = text_buffers(batch[column])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, side="right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi
