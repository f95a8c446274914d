"""Substring dedup on a sparse suffix array of the corpus.

A byte goes if a string of ``length`` (50) bytes covers it that also starts in a
document with a smaller id.  Texts are UTF-8 bytes, matches never cross
documents, and all strings are judged on the input.

Suffixes.  Sorting a suffix per byte would move the corpus ``length`` times.  So
a string of 50 bytes is represented by the smallest hash of its grams of 16
bytes, its anchor, and neighbouring strings with one anchor are one run; about
one byte in eighteen starts a run.  Equal strings have equal anchors, so
only runs of one anchor need be compared:

1. Runs are dealt by anchor as packed arrays of hashes (19 bytes a run and the
   ids).  A run whose bytes are also those of a run in a document with a smaller id is
   repeated as a whole.  Where runs of one anchor differ, the first document
   of each such run sends its bytes to the second step, if another one has the same
   bytes on one side of the anchor: a string that both hold has at least 17 bytes
   before or behind it.  Most anchors of a large corpus are in several documents by
   chance; their runs end here.  A run that holds its anchor twice goes on with all
   others of that anchor.
2. These suffixes, led by the 16 bytes of their anchor, are range-partitioned by
   splitters that Spark samples from the leading bytes and ids, so that one
   anchor may fill many partitions.  Each partition sorts all strings of its suffixes by
   multikey quicksort, eight bytes at a time; equal strings become neighbours,
   and all but those of the smallest id are repeated.
3. An anchor at the edge of a partition may go on in the next one.  Of the
   strings of such anchors each partition sends its first holder, as packed 128-bit
   hashes, and these are compared across partitions.

Memory holds a slice of texts, a bucket of runs or a range of suffixes.  Only
counts reach the driver.  Runs are compared by 64-bit hashes within a 40-bit
anchor hash, suffixes by their bytes.

Nulls: a null text is an empty text; a null id counts as the largest id and is
kept as null.  Rows that share an id are judged by smaller ids only, not by
each other.  An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_rows_if_bounded
from .batches import ID_ROW_BYTES, M1, M2, ODD, frugal, mix64, prefix_sums, slices, span_hashes, text_bytes, whole_groups
from .scratch import Scratch

LENGTH, GRAM = 50, 16
SPREAD = LENGTH - GRAM + 1  #: grams in a string, and strings in a run at most
HALF = SPREAD // 2  #: bytes of a string before its anchor, or else behind it, at least
TWICE = (1 << 24) - 1  #: the halves of a run that holds its anchor twice
LAST = (1 << 63) - 1
LONG = 1 << 20  #: texts longer than this are read piece by piece
BUCKET = 4 << 20  #: bytes of text whose runs make a bucket
FLUSH = 8 << 20  #: bytes of text whose runs are packed together
CUT = 4 << 20  #: bytes of text cut at a time
TOP = np.uint64(1 << 63)


def eights(buf: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position as one integer."""
    n = len(buf) - 7
    out = np.empty(max(n, 0), np.uint64)
    for r in range(min(8, max(n, 0))):
        out[r::8] = np.frombuffer(buf[r:r + (len(buf) - r) // 8 * 8].tobytes(), f"{order}u8")[:len(out[r::8])]
    return out


def grams(buf: np.ndarray) -> np.ndarray:
    """Hashes of the grams of the buffer."""
    e = eights(buf)
    h = e[:-8] * M1 + (e[8:] ^ ODD) * M2
    h ^= h >> np.uint64(29)
    h *= M1
    h ^= h >> np.uint64(32)
    return h


def _sliding(of: np.ufunc, h: np.ndarray) -> np.ndarray:
    """The least or greatest of each ``SPREAD`` values in a row."""
    width = 1
    while width * 2 <= SPREAD:
        h = of(h[:-width], h[width:])
        width *= 2
    rest = SPREAD - width
    return of(h[:-rest], h[rest:]) if rest else h


def anchors(buf: np.ndarray) -> np.ndarray:
    """For each string of the buffer the smallest hash of its grams."""
    return _sliding(np.minimum, grams(buf))


def halves(sums: np.ndarray, h: np.ndarray, a: np.ndarray, inside: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run 24-bit hashes of its anchor with the ``HALF`` bytes before it and with those behind it.

    0: it has fewer there; ``TWICE``, both: it holds its anchor twice.  ``h``, ``a``: ``grams`` and ``anchors``
    of the buffer; ``inside``: its strings that lie in one text.
    """
    edge = np.zeros(SPREAD - 1, np.uint64)
    # a gram is an anchor where it is the greatest of the anchors of all strings around it, as it is none's less
    places = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, np.where(inside, a, np.uint64(0)), edge])) == h)
    end, anchor = s + n + SPREAD - 1, a[s]
    at, found, place = np.searchsorted(places, s), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    left = np.arange(len(s))
    while len(left):
        left = left[at[left] < len(places)]
        k = places[at[left]]
        within = k < end[left]
        left, k = left[within], k[within]
        hit = h[k] == anchor[left]
        new = left[hit]
        place[new[found[new] == 0]] = k[hit][found[new] == 0]
        found[new] += 1
        at[left] += 1
        left = left[found[left] < 2]
    out = []
    for lo, hi, has in ((place - HALF, place + GRAM, place - HALF >= s), (place, place + GRAM + HALF, place + GRAM + HALF <= s + n + LENGTH - 1)):
        v = np.zeros(len(s), np.uint32)
        has &= found == 1
        v[has] = span_hashes(sums, lo[has], hi[has]) % np.uint64(TWICE - 1) + np.uint64(1)
        v[found > 1] = TWICE
        out.append(v)
    return tuple(out)


def runs_in(buf: np.ndarray, offs: np.ndarray, with_halves: bool = False) -> tuple[np.ndarray, ...]:
    """Text number, start, number of strings, anchor and hash of the bytes of each run, and its ``halves`` if asked for."""
    if len(buf) < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), *[z.astype(np.uint32)] * (2 * with_halves)
    h = grams(buf)
    a = _sliding(np.minimum, h)
    edge = np.zeros(len(a) + 1, np.int32)
    inner = offs[1:-1]
    np.add.at(edge, np.minimum(np.maximum(inner - LENGTH + 1, 0), len(a)), 1)
    np.add.at(edge, np.minimum(inner, len(a)), -1)
    inside = np.cumsum(edge[:-1]) == 0
    same = (a[1:] == a[:-1]) & inside[1:] & inside[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~same
    last[:-1] &= ~same
    s, n = np.flatnonzero(first), np.flatnonzero(last)
    n = n - s + 1
    cut = -(-n // SPREAD)  # a run of a text that repeats itself
    if len(cut) and cut.max() > 1:
        own = np.repeat(np.arange(len(s)), cut)
        k = np.arange(len(own)) - np.repeat(np.cumsum(cut) - cut, cut)
        s, n = s[own] + k * SPREAD, np.minimum(n[own] - k * SPREAD, SPREAD)
    sums = prefix_sums(buf)
    c = span_hashes(sums, s, s + n + LENGTH - 1)
    return np.searchsorted(offs, s, "right") - 1, s, n, a[s], c, *(halves(sums, h, a, inside, s, n) if with_halves else ())


def all_runs(buf: np.ndarray, offs: np.ndarray, with_halves: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """``runs_in`` for any number and length of texts, slice by slice; starts count from the start of ``buf``."""
    for lo, hi in slices(offs):
        start, end = offs[lo], offs[hi]
        if hi == lo + 1 and end - start > LONG:
            for at in range(start, end - LENGTH + 1, LONG):
                piece = buf[at:min(at + LONG + LENGTH - 1, end)]
                t, s, *more = runs_in(piece, np.array([0, len(piece)]), with_halves)
                yield t + lo, s + at, *more
        else:
            t, s, *more = runs_in(buf[start:end], offs[lo:hi + 1] - start, with_halves)
            yield t + lo, s + start, *more


def _packed(did: np.ndarray, a: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, buckets: int) -> pa.RecordBatch:
    m = mix64(a)
    b = ((m >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(b, kind="stable")
    b, did = b[order], did[order]
    low = np.ascontiguousarray(m[order]).view(np.uint8).reshape(-1, 8)[:, :5]
    c = c[order]
    sides = np.concatenate([np.ascontiguousarray(x[order]).view(np.uint8).reshape(-1, 4)[:, :3] for x in (left, right)], axis=1)
    cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
    rows = []
    for s, e in zip(cut[:-1], cut[1:]):
        d = did[s:e]
        turn = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1, [e - s]])
        rows.append((int(b[s]), low[s:e].tobytes(), c[s:e].tobytes(), sides[s:e].tobytes(), d[turn[:-1]].tobytes(), np.diff(turn).astype(np.uint32).tobytes()))
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["b", "a", "c", "sides", "did", "n"])


def _by_document(did: np.ndarray, c: np.ndarray, whole: bool) -> pa.RecordBatch:
    order = np.argsort(did, kind="stable")
    did, c = did[order], c[order]
    cut = np.concatenate([[0], np.flatnonzero(did[1:] != did[:-1]) + 1]).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(did)), pa.int32()), pa.array(c.view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(did[cut]), pa.array(np.full(len(cut), whole)), lists], ["did", "whole", "c"])


def _apart(of: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which belong to a group (``of``, numbers in order) that has different values of ``least``."""
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
    if not len(start):
        return np.zeros(0, bool)
    differ = np.minimum.reduceat(least, start) != np.maximum.reduceat(least, start)
    return np.repeat(differ, np.diff(np.append(start, len(of))))


def judge_runs(a: np.ndarray, c: np.ndarray, did: np.ndarray, *sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs with all others of their anchors: those repeated as a whole, and those whose bytes must be compared.

    Both as row numbers; the latter are the first documents of runs that differ from others of their anchor,
    of those with ``halves`` (``sides``) the ones that share one with another document's.
    """
    order = np.lexsort((did, c, a))
    a, c, d = a[order], c[order], did[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_a | np.concatenate([[True], c[1:] != c[:-1]])
    head = np.flatnonzero(new)
    least = d[head]
    whole = order[d > least[np.cumsum(new) - 1]]
    # anchors whose different runs start in different documents
    of = np.cumsum(new_a)[head] - 1
    apart = np.flatnonzero(_apart(of, least))
    if not sides or not len(apart):
        return whole, order[head[apart]]
    of, least, rows = of[apart], least[apart], order[head[apart]]
    twice = sides[0][rows] == TWICE
    alike = np.isin(of, of[twice])
    for side in sides:
        half = side[rows]
        has = np.flatnonzero(half)
        has = has[np.lexsort((half[has], of[has]))]
        alike[has[_apart(of[has] << np.int64(24) | half[has].astype(np.int64), least[has])]] = True
    return whole, rows[alike]


def multikey_groups(buf: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Group numbers of the strings at ``pos``, equal for equal strings, by multikey quicksort.

    Eight bytes at a time: strings equal so far are ordered by their next eight
    bytes, and groups of one string are settled.
    """
    e = eights(buf, ">")
    group = np.zeros(len(pos), np.int64)
    left = np.arange(len(pos))
    done = 0
    for step in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        key = e[pos[left] + step]
        order = np.lexsort((key, group[left]))
        left, key = left[order], key[order]
        g = group[left]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        g = done + np.cumsum(new) - 1
        group[left] = g
        done = int(g[-1]) + 1
        size = np.bincount(g - g[0])
        left = left[size[g - g[0]] > 1]
        if not len(left):
            break
    return group


FINE = "did long, c long, mask long, b long, h0 binary, h1 binary, holder binary, run binary, t binary"
_PACKED = (("h0", np.uint64), ("h1", np.uint64), ("holder", np.int64), ("run", np.int64), ("t", np.uint8))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _masks(did: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document and run the strings ``t`` as a mask."""
    order = np.lexsort((c, did))
    did, c, bit = did[order], c[order], np.int64(1) << t[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (c[1:] != c[:-1])])) if len(did) else np.zeros(0, np.int64)
    return did[head], c[head], np.bitwise_or.reduceat(bit, head) if len(head) else bit


def _fine(did: np.ndarray, c: np.ndarray, mask: np.ndarray, packed: list[tuple] = ()) -> pa.RecordBatch:
    """Rows of FINE: masks, then packed holders by bucket."""
    n, cols = len(did), list(zip(*packed)) or [()] * 6
    none = [None] * len(packed)
    arrays = [pa.array([*x.tolist(), *none], pa.int64()) for x in (did, c, mask)]
    arrays.append(pa.array([*[None] * n, *cols[0]], pa.int64()))
    arrays += [pa.array([*[None] * n, *x], pa.binary()) for x in cols[1:]]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in FINE.split(", ")])


def _compare(tab: pa.Table, edge: bool, buckets: int) -> pa.RecordBatch:
    """Strings of some whole anchors of a range: the repeated ones as masks.

    At an edge the anchor may go on in the next range, so each different
    string's first holder here goes on too, to be compared with those of other ranges.
    """
    tab = tab.combine_chunks()
    did, c = tab.column("did").to_numpy(), tab.column("c").to_numpy()
    col = tab.column("s").combine_chunks().cast(pa.large_binary())
    _, o, data = col.buffers()
    offs = np.frombuffer(o, np.int64, len(col) + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    n = np.diff(offs) - LENGTH + 1
    pos, own = _ranges(offs[:-1], n), np.repeat(np.arange(len(n)), n)
    t = pos - offs[own]
    g = multikey_groups(buf, pos)
    order = np.lexsort((did[own], g))
    head = np.concatenate([[True], g[order][1:] != g[order][:-1]])
    first = order[head]  # of each string, the row of its smallest id
    least = np.empty(g.max() + 1, np.int64)
    least[g[first]] = did[own[first]]
    late = did[own] > least[g]
    masks = _masks(did[own[late]], c[own[late]], t[late])
    if not edge:
        return _fine(*masks)
    first = np.flatnonzero(did[own] == least[g])  # all its places there: the document may hold it in several runs
    pos, own, t = pos[first], own[first], t[first]
    h0 = span_hashes(prefix_sums(buf), pos, pos + LENGTH)
    e = eights(buf)
    h1 = np.zeros(len(pos), np.uint64)
    for step in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h1 = mix64(h1 + e[pos + step] * ODD)
    b = (h0 % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(b[order][1:] != b[order][:-1]) + 1, [len(b)]])
    columns = (h0, h1, did[own], c[own], t.astype(np.uint8))
    return _fine(*masks, [(int(b[order[s]]), *(x[order[s:e]].tobytes() for x in columns)) for s, e in zip(cut[:-1], cut[1:])])


def meet_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holders of equal strings from different ranges: all but the smallest id's are repeated.

    A range sends a string once, with all runs of one document that hold it.
    """
    for tab in whole_groups(batches, "b"):
        for s, e in zip(*_bucket_rows(tab)):
            part = tab.slice(s, e - s)
            h0, h1, did, c, t = (np.frombuffer(b"".join(x.as_py() for x in part.column(k)), kind) for k, kind in _PACKED)
            order = np.lexsort((did, h1, h0))
            new = np.concatenate([[True], (h0[order][1:] != h0[order][:-1]) | (h1[order][1:] != h1[order][:-1])])
            least = did[order][new][np.cumsum(new) - 1]
            late = order[did[order] > least]
            if len(late):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _masks(did[late], c[late], t[late])], ["did", "c", "mask"])


def compare_suffixes(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One range of suffixes in the order of their leading bytes; its first and last leading eight bytes are its edges."""
    held, first = None, True
    for tab in whole_groups(batches, "l0"):
        if held is not None:
            yield _compare(held, first, buckets)
            first = False
        # only the last group may go on in the next range, only the first may come from the one before
        lead = tab.column("l0").combine_chunks().to_numpy()
        cut = int(np.flatnonzero(lead == lead[-1])[0])
        start = int(np.flatnonzero(lead != lead[0])[0]) if cut and first else 0
        if start:
            yield _compare(tab.slice(0, start), True, buckets)
        if cut > start:
            yield _compare(tab.slice(start, cut - start), False, buckets)
        first = first and not cut
        held = tab.slice(cut)
    if held is not None:
        yield _compare(held, True, buckets)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each element of a list column."""
    sizes = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(col)), sizes), col.flatten()


def _named(row: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix64(c + row.astype(np.uint64) * ODD)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, spans, kept`` per document.

    ``spans``: maximal removed ranges of bytes (ends exclusive); ``kept``: the
    remaining bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(1, -(-total // BUCKET)), 1 << 24)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for b in batches:
            buf, offs = text_bytes(b.column("text"))
            did = b.column("did").to_numpy()
            for t, _, n, *hashes in all_runs(buf, offs, with_halves=True):
                if len(t):
                    kept.append((did[t], *hashes))
                    size += int(n.sum())
                    if size >= FLUSH:
                        yield _packed(*(np.concatenate(x) for x in zip(*kept)), buckets)
                        kept, size = [], 0
        if kept:
            yield _packed(*(np.concatenate(x) for x in zip(*kept)), buckets)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in whole_groups(batches, "b"):
            for s, e in zip(*_bucket_rows(tab)):
                part = tab.slice(s, e - s)
                a5, c, halves6, d, n = (np.frombuffer(b"".join(x.as_py() for x in part.column(k)), kind)
                                        for k, kind in (("a", np.uint8), ("c", np.uint64), ("sides", np.uint8), ("did", np.int64), ("n", np.uint32)))
                a = np.zeros((len(c), 8), np.uint8)
                a[:, :5] = a5.reshape(-1, 5)
                sides = np.zeros((len(c), 2, 4), np.uint8)
                sides[:, :, :3] = halves6.reshape(-1, 2, 3)
                did = np.repeat(d, n)
                for x, whole in zip(judge_runs(a.view(np.uint64).ravel(), c, did, *sides.view(np.uint32)[:, :, 0].T), (True, False)):
                    if len(x):
                        yield _by_document(did[x], c[x], whole)

    dealt = rows.mapInArrow(frugal(deal), "b long, a binary, c binary, sides binary, did binary, n binary")
    judged = dealt.repartition("b").sortWithinPartitions("b").mapInArrow(frugal(judge), "did long, whole boolean, c array<long>")
    judged = scratch.write(judged, "judged")

    # bytes of runs that differ from others of their anchor
    unclear = scratch.write(judged.filter("not whole").groupBy("did").agg(F.flatten(F.collect_list("c")).alias("c")), "unclear")
    asked = _only(rows, unclear, scratch, "asked").join(unclear, "did")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_bytes(b.column("text"))
            did = b.column("did").to_numpy()
            row, want = _flat(b.column("c"))
            want = _named(row, want.to_numpy().view(np.uint64))
            for t, s, n, a, c in all_runs(buf, offs):
                x = np.flatnonzero(np.isin(_named(t, c), want))
                if not len(x):
                    continue
                # a run that a text holds twice is sent once
                x = x[np.unique(_named(t[x], c[x]), return_index=True)[1]]
                t, s, n, a, c = t[x], s[x], n[x], a[x], c[x]
                size = n + LENGTH - 1
                data = buf[_ranges(s, size)]
                at = np.concatenate([[0], np.cumsum(size)])
                lead = _leads(data, at, a)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array((v ^ TOP).view(np.int64)) for v in lead), pa.array(did[t]), pa.array(c.view(np.int64)), text], ["l0", "l1", "did", "c", "s"])

    # written first: sampling the splitters and dealing the rows both read them
    suffixes = scratch.write(asked.mapInArrow(frugal(send), "l0 long, l1 long, did long, c long, s binary"), "suffixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = suffixes.repartitionByRange(parts, "l0", "l1", "did", "c").sortWithinPartitions("l0").mapInArrow(frugal(lambda b: compare_suffixes(b, parts)), FINE)
    fine = scratch.write(fine, "fine")
    edges = fine.filter("b is not null").drop("did", "c", "mask")
    late = edges.repartition("b").sortWithinPartitions("b").mapInArrow(frugal(meet_holders), "did long, c long, mask long")
    masks = fine.filter("b is null").select("did", "c", "mask").union(late)
    masks = masks.groupBy("did", "c").agg(F.bit_or("mask").alias("mask"))

    # per document what to remove; bounded by its own runs
    gone = judged.filter("whole").select("did", F.col("c"), F.lit(None).cast("array<struct<c:long,mask:long>>").alias("m")).union(
        masks.groupBy("did").agg(F.collect_list(F.struct("c", "mask")).alias("m")).select("did", F.lit(None).cast("array<long>"), "m"))
    gone = scratch.write(gone.groupBy("did").agg(F.flatten(F.collect_list("c")).alias("c"), F.flatten(F.collect_list("m")).alias("m")), "gone")
    hit = _only(rows, gone, scratch, "hit").join(gone, "did")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_bytes(b.column("text"))
            for lo, hi in slices(offs, CUT):
                did, c, m = (b.column(k).slice(lo, hi - lo) for k in ("did", "c", "m"))
                yield _without_strings(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], did, c, m)

    schema = "did long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    clean = _without(rows, gone, scratch, "hit").select("did", F.octet_length("text").cast("long").alias("n_bytes"),
                                                          F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    done = hit.mapInArrow(frugal(remove), schema).union(clean)
    return done.select(F.when(F.col("did") < LAST, F.col("did")).alias(id_col), "n_bytes", "spans", "kept")


def _without_strings(buf: np.ndarray, offs: np.ndarray, did: pa.Array, c: pa.Array, m: pa.Array) -> pa.RecordBatch:
    """Some texts without the strings of their whole runs ``c`` and of their masked runs ``m``."""
    row, whole = _flat(c)
    whole = _named(row, whole.to_numpy().view(np.uint64))
    row, part = _flat(m)
    part_c, mask = _named(row, part.field("c").to_numpy().view(np.uint64)), part.field("mask").to_numpy()
    order = np.argsort(part_c)
    part_c, mask = part_c[order], mask[order]
    edge = np.zeros(len(buf) + 1, np.int32)  # +1 where a removed string starts, -1 where it ends
    for t, s, n, _, c in all_runs(buf, offs):
        name = _named(t, c)
        x = np.isin(name, whole)
        np.add.at(edge, s[x], 1)
        np.add.at(edge, s[x] + n[x] + LENGTH - 1, -1)
        if len(part_c):
            at = np.minimum(np.searchsorted(part_c, name), len(part_c) - 1)
            for i in np.flatnonzero((part_c[at] == name) & ~x):
                bits = int(mask[at[i]])
                start = s[i] + np.array([k for k in range(SPREAD) if bits >> k & 1], np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + LENGTH, -1)
    cover = np.cumsum(edge[:-1], dtype=np.int32) > 0
    turn = np.diff(np.concatenate([[False], cover, [False]]).view(np.int8))
    # a removed range that goes on at the start of the next text is two
    inner = np.unique(offs[1:-1])
    inner = inner[(inner > 0) & (inner < len(buf))]
    inner = inner[cover[inner] & cover[inner - 1]]
    s = np.sort(np.concatenate([np.flatnonzero(turn == 1), inner]))
    e = np.sort(np.concatenate([np.flatnonzero(turn == -1), inner]))
    at = np.searchsorted(offs, s, "right") - 1
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(offs))), pa.int32()),
                                     pa.StructArray.from_arrays([pa.array(s - offs[at]), pa.array(e - offs[at])], ["start", "end"]))
    removed = np.bincount(at, weights=e - s, minlength=len(offs) - 1).astype(np.int64)
    left = np.concatenate([[0], np.cumsum(np.diff(offs) - removed)])
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(left), pa.py_buffer(buf[~cover])]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([did, pa.array(np.diff(offs)), spans, kept], ["did", "n_bytes", "spans", "kept"])


def _bucket_rows(tab: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    b = tab.column("b").combine_chunks().to_numpy()
    cut = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
    return cut[:-1], cut[1:]


def _only(rows: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows whose document is in ``ids``, so that other texts are not shuffled."""
    few = scratch.write(ids.select("did"), name)
    return rows.join(broadcast_rows_if_bounded(few, few.count(), ID_ROW_BYTES), "did", "left_semi")


def _without(rows: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    few = ids.select("did")
    return rows.join(broadcast_rows_if_bounded(few, few.count(), ID_ROW_BYTES), "did", "left_anti")


def _leads(data: np.ndarray, at: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes of each run's anchor, as two integers in the order of the bytes."""
    e = eights(data, ">")
    little = eights(data)
    h = little[:-8] * M1 + (little[8:] ^ ODD) * M2
    h ^= h >> np.uint64(29)
    h *= M1
    h ^= h >> np.uint64(32)
    place = np.full(len(a), -1)
    last = at[1:] - LENGTH  # the last string of the run
    for k in range(SPREAD - 1, -1, -1):
        hit = h[last + k] == a
        place[hit] = (last + k)[hit]
    return e[place], e[place + 8]
