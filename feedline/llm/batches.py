"""Helpers for Arrow-batched Python operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that each hold complete runs of ``key`` from batches sorted by it.

    A run that goes on past a batch is carried over, so memory holds one batch
    and one run; callers bound the length of a run by how they key their rows.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(key)
        first, end = col[0].as_py(), col[-1].as_py()
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if first == end:
            held.append(b)
            last = end
            continue
        vals = col.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(vals != vals[-1])[-1]) + 1
        held.append(b.slice(0, cut))
        yield pa.Table.from_batches(held)
        held, last = [b.slice(cut)], end
    if held:
        yield pa.Table.from_batches(held)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until none of ``columns`` is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of whole rows.  Nulls count; columns that cannot be hashed (maps, variants) count as their JSON."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{f.name}`")
            for f in df.schema]
    cols += [c.isNull() for c in cols]  # hashes pass over nulls
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)


#: Bytes of a broadcast row that holds one id (about 110 are measured).
ID_ROW_BYTES = 128

Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(scan: Scan) -> Scan:
    """``scan``, giving freed memory back to the system when a task ends.

    Python workers serve one task after the other; what their allocators keep
    from a large one would count against the executor from then on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that outputs of long texts stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of equal neighbours."""
    if not len(keys):
        z = np.zeros(0, np.int64)
        return z, z
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one uint8 array, and the n + 1 offsets of its rows.

    A null counts as empty.
    """
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[o[0]:o[-1]], o - o[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per text, the n + 1 offsets into them."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = ~SPACE[buf]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    edges = offs[:-1][offs[:-1] < offs[1:]]
    start[edges] = ink[edges]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    tails = edges[1:] - 1
    end[tails] = ink[tails]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = mix64(np.arange(256, dtype=np.uint64) * ODD + M2)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... as wrapped 64-bit integers; the longest table made so far is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p)
    return have[:n]


def running_sums(values: np.ndarray) -> np.ndarray:
    """S[i]: the wrapped sum of value * base^position over the first i unsigned 64-bit values."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=s[1:])
    return s


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S[i]: the wrapped sum of table[byte] * base^position over the first i bytes."""
    return running_sums(_TABLE[buf])


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, given ``prefix_sums`` of their buffer; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inv = powers(_INV, len(sums))
    return mix64((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def planes(a: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each little-endian integer, first all lowest ones: bytes that vary little lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, :width].T).tobytes()


def from_planes(data: memoryview | bytes, width: int, dtype: type) -> np.ndarray:
    """The integers of ``planes``; bytes not kept are 0."""
    got = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = got.T
    return out.view(dtype).ravel()


def slices(offs: np.ndarray, budget: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes each; a longer text is a range of its own."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi
