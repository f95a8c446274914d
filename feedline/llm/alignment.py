"""Cross-tokenizer alignment of a byte-level BPE (A) with a sentence-piece model (B).

Each text, with one space before it, is cut by both tokenizers; the byte offsets
where tokens of both end cut the two sequences into groups.  The last A and the
last B token of a group end together: that pair of occurrences is a link.

Method.  A map made once from the vocabularies gives each A id the B id of the
same bytes.  A group of one A and one B token of equal bytes is a link of that
map and is counted by its A id in a vector as long as A's vocabulary; only the
links of irregular groups enter the shuffle of pairs.  Of two tokens that end
together one's bytes end the other's, so there are no more pairs than bytes in
both vocabularies: whatever the corpus, all counts together are a table of
bounded size (about half a million pairs here), which is broadcast.

Neither tokenizer has a token that goes on past a space behind other bytes
(checked on loading), so texts are cut there into segments, each distinct segment
of a slice is tokenised and aligned once, and texts are put together from them.

Null and empty texts, and texts that the tokens' bytes do not give back, have no
tokens: their counts are 0 and their groups ''.  Rows that repeat are rows of
their own and count again.  An empty table gives an empty one.  Other columns are
kept where named in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import frugal, parts, slices, text_bytes

#: Segments remembered by a worker before it starts anew, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 300_000, 16 << 20
#: Texts whose links are looked at together.
LINKED_ROWS = 500


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pair:
    """Both tokenizers, loaded in a worker."""

    a: object
    b: object
    a_bytes: list[bytes] = field(default_factory=list)
    b_bytes: list[bytes] = field(default_factory=list)

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Pair:
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        a.no_truncation()
        a.no_padding()
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        entries = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in entries]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(b.id_to_piece(i) for i in range(b.get_piece_size()))]
        if any(b" " in t.lstrip(b" ") for t in b_bytes):
            raise ValueError("a piece goes on past a space")
        return cls(a, b, a_bytes, b_bytes)

    def same(self) -> np.ndarray:
        """For each A id the B id of the same bytes (not a single-byte fallback where a piece has them), or -1."""
        of = {}
        for i, t in sorted(enumerate(self.b_bytes), key=lambda x: self.b.is_byte(x[0])):
            of.setdefault(t, i)
        return np.array([of.get(t, -1) for t in self.a_bytes], np.int64)


def most_pairs(pair: Pair) -> int:
    """A bound on the pairs of ids that can be linked: one ends with the other's bytes."""
    return sum(map(len, pair.a_bytes)) + sum(map(len, pair.b_bytes))


def segment_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the segments of texts: their own starts and each space behind a byte that is not white space in any script."""
    back = lambda k: np.concatenate([np.full(k, 0x20, np.uint8), buf[:-k]]) if len(buf) >= k else np.full(len(buf), 0x20, np.uint8)
    one, two, three = back(1), back(2), back(3)
    blank = (one <= 0x20) | ((one == 0x85) | (one == 0xA0)) & (two == 0xC2)
    # the three-byte blocks that hold white space
    blank |= (one >= 0x80) & (((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)))
    cut = (buf == 0x20) & ~blank
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(cut)


class Bytes:
    """A growing column of byte strings."""

    def __init__(self):
        self.data, self.offs, self.n = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64), 0

    def extend(self, data: np.ndarray, sizes: np.ndarray) -> None:
        at, n = int(self.offs[self.n]), self.n
        while len(self.data) < at + len(data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while len(self.offs) < n + len(sizes) + 1:
            self.offs = np.concatenate([self.offs, np.zeros_like(self.offs)])
        self.data[at:at + len(data)] = data
        self.offs[n + 1:n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.n = n + len(sizes)

    def take(self, at: np.ndarray) -> pa.Array:
        col = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.offs), pa.py_buffer(self.data)])
        return col.take(pa.array(at))


class Lexicon:
    """Segments with their numbers of tokens and groups, groups as text, plain links and other links."""

    def __init__(self, pair: Pair):
        self.pair, self.same = pair, pair.same()
        self.space = [i for i, t in enumerate(pair.b_bytes) if t == b" " and not pair.b.is_byte(i)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (pair.a_bytes, pair.b_bytes))
        self.na, self.nb = len(pair.a_bytes), len(pair.b_bytes)
        # an id as text with what follows it: another id of its group, or not
        self.names = pa.array([b"%d%s" % (i, end) for n, last in ((self.na, b"|"), (self.nb, b";")) for end in (b",", last) for i in range(n)], pa.large_binary())
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.numbers = np.zeros((0, 4), np.int64)  #: tokens of A and B, groups, whether the tokens give the segment back
        self.text, self.fast, self.slow = Bytes(), Bytes(), Bytes()

    def _add(self, segs: list[bytes]) -> None:
        strings = [s.decode() for s in segs]
        a = [x.ids for x in self.pair.a.encode_batch(strings, add_special_tokens=False)]
        b = [self.space if s == " " else x for s, x in zip(strings, self.pair.b.encode([s[1:] for s in strings], num_threads=1))]
        size = np.array([len(s) for s in segs])
        good = self._gives(a, self.pair.a_bytes, self.a_size, segs, size) & self._gives(b, self.pair.b_bytes, self.b_size, segs, size)
        empty: list[int] = []
        (a, na), (b, nb) = (self._flat([x if ok else empty for x, ok in zip(ids, good)]) for ids in (a, b))
        # places where tokens of both end, over all segments one after the other: each ends there itself
        _, ia, ib = np.intersect1d(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), assume_unique=True, return_indices=True)
        la, lb = a[ia], b[ib]
        plain = (np.diff(ia, prepend=-1) == 1) & (np.diff(ib, prepend=-1) == 1) & (self.same[la] == lb)
        owner = np.searchsorted(np.cumsum(na), ia, "right")
        n = len(segs)
        groups = np.bincount(owner, minlength=n)
        # a group's A tokens come before its B tokens
        ga, gb = np.searchsorted(ia, np.arange(len(a))), np.searchsorted(ib, np.arange(len(b)))
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ia], last_b[ib] = self.na, self.nb
        name = np.empty(len(a) + len(b), np.int64)
        name[np.arange(len(a)) + np.concatenate([[0], ib + 1])[ga]] = a + last_a
        name[np.arange(len(b)) + (ia + 1)[gb]] = 2 * self.na + b + last_b
        text = self.names.take(pa.array(name))
        offs = np.frombuffer(text.buffers()[1], np.int64, len(name) + 1) if len(name) else np.zeros(1, np.int64)
        ends = offs[np.cumsum(na + nb)]
        data = np.frombuffer(text.buffers()[2], np.uint8)[:ends[-1]] if len(name) else np.zeros(0, np.uint8)
        self.text.extend(data, np.diff(ends, prepend=0))
        self.fast.extend(la[plain].astype(np.int32).view(np.uint8), 4 * np.bincount(owner[plain], minlength=n))
        self.slow.extend((la * self.nb + lb)[~plain].view(np.uint8), 8 * np.bincount(owner[~plain], minlength=n))
        self.place.update(zip(segs, range(len(self.numbers), len(self.numbers) + n)))
        self.numbers = np.concatenate([self.numbers, np.column_stack([na, nb, groups, good])])
        self.bytes += int(size.sum())

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes

    def _gives(self, ids: list[list[int]], of: list[bytes], width: np.ndarray, segs: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are the segment."""
        flat, n = self._flat(ids)
        whole = np.concatenate([[0], np.cumsum(width[flat])])[np.concatenate([[0], np.cumsum(n)])]
        good = np.diff(whole) == size
        if good.all() and b"".join([of[i] for i in flat.tolist()]) == b"".join(segs):
            return good
        return np.array([b"".join([of[i] for i in x]) == s for x, s in zip(ids, segs)])

    def look_up(self, segs: list[bytes]) -> np.ndarray:
        """Places of distinct segments, new ones added; places given before are void if the memory was full."""
        if len(self.place) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._clear()
        new = [s for s in segs if s not in self.place]
        if new:
            self._add(new)
        return np.array([self.place[s] for s in segs], np.int64)


@lru_cache(maxsize=1)
def lexicon(a_path: str, b_path: str) -> Lexicon:
    """A worker's own, kept from task to task."""
    return Lexicon(Pair.load(a_path, b_path))


def token_groups(docs: DataFrame, a_path: str, b_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                 a_text: bool = True) -> DataFrame:
    """``keep`` in a struct ``row``, then ``n_a, n_b, n_groups``, ``groups`` and the links.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids (null without ``a_text``);
    ``fast`` packs the A ids of plain links as 32-bit, ``slow`` the other links'
    ``a * size of B + b`` as 64-bit integers.
    """
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(a_path, b_path)
        for b in batches:
            buf, offs = text_bytes(b.column("text"))
            for lo, hi in slices(offs):
                part, at = buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                yield _align_slice(lex, b.column("row").slice(lo, hi - lo), part, at, a_text)

    return kept.mapInArrow(frugal(cut), T.StructType([kept.schema["row"], *T._parse_datatype_string(
        "n_a long, n_b long, n_groups long, groups string, fast binary, slow binary")]))


def _align_slice(lex: Lexicon, row: pa.Array, buf: np.ndarray, offs: np.ndarray, a_text: bool) -> pa.RecordBatch:
    n = len(row)
    size = np.diff(offs)
    own = np.flatnonzero(size)  # a space before each text that is not empty
    moved = np.concatenate([[0], np.cumsum(size + (size > 0))])
    full = np.full(int(moved[-1]), 0x20, np.uint8)
    keep = np.ones(len(full), bool)
    keep[moved[:-1][own]] = False
    full[keep] = buf
    starts = segment_starts(full, moved)
    segs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(full)).astype(np.int64)), pa.py_buffer(full)])
    coded = segs.dictionary_encode()
    place = lex.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
    doc = np.searchsorted(moved, starts, "right") - 1
    bad = np.zeros(n, bool)
    bad[doc[lex.numbers[place, 3] == 0]] = True
    fine = ~bad[doc]
    place, doc = place[fine], doc[fine]
    edge = np.searchsorted(doc, np.arange(n + 1))  # segments before each text
    sums = [np.diff(np.concatenate([[0], np.cumsum(lex.numbers[place, i])])[edge]) for i in range(3)]
    cols = [_by_text(c.take(place), edge) for c in (lex.fast, lex.slow)]
    groups = pc.ascii_rtrim(_by_text(lex.text.take(place), edge).cast(pa.string()), ";") if a_text else pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([row, *map(pa.array, sums), groups, *cols], ["row", "n_a", "n_b", "n_groups", "groups", "fast", "slow"])


def _by_text(col: pa.Array, edge: np.ndarray) -> pa.Array:
    """The strings of each text's segments joined."""
    if not len(col):
        return pa.array([b""] * (len(edge) - 1), pa.binary())
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64, len(col) + 1, 8 * col.offset)[edge].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(at), data]).cast(pa.binary())


def _numbers(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in a column, and the n + 1 offsets of its rows into them."""
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64, len(col) + 1, 8 * col.offset) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw.copy().view(kind), (at - at[0]) // np.dtype(kind).itemsize


def pair_counts(groups: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a, b, count``: how many links of the whole corpus hold each pair of ids; at most ``most_pairs`` rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(a_path, b_path)
        same, nb = pair.same(), len(pair.b_bytes)
        lexicon.cache_clear()  # of a worker that has aligned before
        vector = np.zeros(len(same), np.int64)
        pairs, seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in parts(batches, LINKED_ROWS):
            fast, slow = (_numbers(b.column(c), k)[0] for c, k in (("fast", np.int32), ("slow", np.int64)))
            vector += np.bincount(fast, minlength=len(vector))
            got, n = np.unique(slow, return_counts=True)
            pairs, back = np.unique(np.concatenate([pairs, got]), return_inverse=True)
            seen = np.bincount(back, np.concatenate([seen, n]), len(pairs)).astype(np.int64)
        a = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((a, pairs // nb), (same[a], pairs % nb), (vector[a], seen))], ["a", "b", "count"])

    return groups.select("fast", "slow").mapInArrow(frugal(count), "a long, b long, count long").groupBy("a", "b").agg(F.sum("count").alias("count"))


def best_matches(counts: DataFrame) -> DataFrame:
    """For each B id the A ids linked with it most often, ties included: ``b, a, count``."""
    most = counts.groupBy("b").agg(F.max("count").alias("count"))
    return counts.join(most, ["b", "count"]).select("b", "a", "count")


def score_links(groups: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``groups`` with ``n_links``, ``n_best`` (links whose count is the highest of their B id) and ``count_sum`` in place of the links.

    ``counts``: the pairs of ``pair_counts``, bounded by the vocabularies; they
    go through the driver as arrays of 24 bytes a pair.
    """
    spark = groups.sparkSession
    got = counts.toArrow()
    a, b, n = (got.column(c).to_numpy() for c in ("a", "b", "count"))
    pair = Pair.load(a_path, b_path)
    if len(a) > most_pairs(pair):
        raise ValueError("more pairs than two vocabularies can give")
    nb = len(pair.b_bytes)
    key = a * nb + b
    order = np.argsort(key)
    top = np.zeros(nb, np.int64)
    np.maximum.at(top, b, n)
    same = pair.same()
    plain = np.zeros(len(same), np.int64)
    is_plain = same[a] == b
    plain[a[is_plain]] = n[is_plain]
    shared = spark.sparkContext.broadcast((key[order], n[order], (n == top[b])[order], plain, plain == top[np.maximum(same, 0)]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best, plain, plain_best = shared.value
        lexicon.cache_clear()
        for b in parts(batches, LINKED_ROWS):
            total = np.zeros((3, b.num_rows), np.int64)
            for c, k in (("fast", np.int32), ("slow", np.int64)):
                values, edge = _numbers(b.column(c), k)
                at = values if c == "fast" else np.searchsorted(keys, values)
                n, top = (plain[at], plain_best[at]) if c == "fast" else (count[at], best[at])
                for i, v in enumerate((np.ones(len(at), np.int64), top, n)):
                    total[i] += np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[edge])
            names = [x for x in b.schema.names if x not in ("fast", "slow")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *map(pa.array, total)], [*names, "n_links", "n_best", "count_sum"])

    fields = [f for f in groups.schema if f.name not in ("fast", "slow")]
    return groups.mapInArrow(frugal(score), T.StructType([*fields, *T._parse_datatype_string("n_links long, n_best long, count_sum long")]))
