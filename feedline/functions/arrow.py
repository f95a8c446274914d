"""Arrow batches in Python workers: what is made of them is bounded by bytes, not by the rows of a batch."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are Python objects at a time; a longer text is alone.
SLICE = 1 << 20


def slices(col: pa.Array, budget: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes of a string column each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)  # empty ones weigh too
    lo, used = 0, 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(ends, used + budget, "right")))
        yield lo, hi
        lo, used = hi, int(ends[hi - 1])


def small(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``budget`` bytes of ``column``; at the end freed memory goes back to the system."""
    for b in batches:
        for lo, hi in slices(b.column(column), budget):
            yield b.slice(lo, hi - lo)
    release()


def release() -> None:
    """Gives freed memory back: workers serve one task after the other and would keep what a large one took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(cols: Iterator[pa.Array], of, kind: pa.DataType) -> Iterator[pa.Array]:
    """``of(text)`` for each row of string columns, as columns of ``kind``, by slices."""
    for col in cols:
        parts = [pa.array([of(t) for t in col.slice(lo, hi - lo).to_pylist()], kind) for lo, hi in slices(col)]
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        del parts, col
    release()
