"""What the operators share: the shared folder, staged tables and packed integer columns."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..staging import shared_dir, staged  # noqa: F401


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores appended until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


@functools.cache
def lean() -> None:
    """Let this process give large arrays back to the system when they are freed, since idle Python workers stay.

    Without it, glibc and Arrow's own pool keep what a worker once held, and executors carry several workers.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (one more than rows); null is an empty text."""
    lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are data[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian base-128 bytes of non-negative integers below 2**35, and the byte length of each."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= np.uint64(1 << (7 * k))
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        if not has.any():
            break
        low = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[at[has] + k] = np.where(size[has] > k + 1, low | 128, low)
    return out, size


def unvarint(data: np.ndarray) -> np.ndarray:
    """The integers that varint() packed."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(5):
        has = ends - starts >= k
        if not has.any():
            break
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of lengths[i] elements each, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
