"""Arrow batches as flat numpy buffers, cut so that memory stays bounded.

Operators read ``doc_id`` and ``text`` by name and ignore other columns, so
extra columns can't clash with theirs. A null text counts as an empty one.
Working memory is a few times ``SLICE_BYTES``, or the longest single text.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at a time.
SLICE_BYTES = 1 << 20


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def folds(ids: list[int | None], parts: int) -> np.ndarray:
    """The same in numpy; a null id has fold -1."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % parts for i in ids], np.int64)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column, without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes, or one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets from 0 of each slice of a string column."""
    data, at = strings(column)
    for i, j in slices(at, most):
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
_Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def released(kernel: _Kernel) -> _Kernel:
    """The same kernel; at its end the worker gives back what was freed.

    Arrow and the C library would keep that for the worker's next task, which
    may be long in coming, beside all that the executor does meanwhile.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(it)
        finally:
            release()

    return run
