"""Byte-level BPE by dynamic programming over prefixes.

A merge table leaves exactly one token that can end the encoding of a prefix.
So for every prefix of a piece the encoder stores that last token: the
automaton over the vocabulary reports, by its suffix links, each token that
ends at a position; a token is the one if it is compatible with the last token
stored where it starts, that is, if merging the bytes of the two tokens gives
just these two.  Following the stored tokens back from the end gives the ids.
The work is linear in the text for any piece, also for one without a space.

The vocabulary is a ``tokenizers`` JSON file with a byte-level pre-tokenizer; its
size is fixed, so its text is broadcast.  Texts are whole; special tokens named
in the file are found in the text before anything else, as the library does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import frugal, parts

#: Fixed value: how byte-level pre-tokenizers split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of at most this many bytes are remembered, and at most twice so many of them at a time.
KEEP_BYTES, KEEP_PIECES = 64, 150_000
#: Results of pair tests remembered at a time.
KEEP_SEAMS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """piece -> bytes of its ids.  When full it starts anew and takes over what is used again, so it stays small on any corpus."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = np.array(self.encode(raw), "<u4").tobytes()
            if len(raw) > KEEP_BYTES:
                return ids
        if len(self) >= KEEP_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Bpe:
    def __init__(self, spec: str):
        spec = json.loads(spec)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y = (bytes(alphabet[c] for c in t) for t in (a, b))
            t = vocab[x + y]
            if self.rank[t] >= 0:
                raise ValueError(f"token {t} comes from two merges; the last token of a prefix is then not unique")
            self.rank[t], self.left[t], self.right[t] = r, vocab[x], vocab[y]
            self.pair[vocab[x], vocab[y]] = r
        self.bytes: list[bytes] = [b""] * size
        self.tokens = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.bytes[i] = t
            if len(t) == 1 or self.rank[i] >= 0:
                self.tokens.add_word(t.decode("latin-1"), (i, len(t)))
        self.tokens.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.pieces = _Pieces(self.piece)
        self.seams: dict[int, bool] = {}  # pairs tested so far

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` side by side merge to ``a, b``.

        Undoes the merges at the seam, the latest first.  Before each undone
        merge the two tokens at the seam stood side by side, and a merge of
        them of lower rank would have come first (of equal rank: the one
        further left).
        """
        rank, pair = self.rank, self.pair
        limit = len(rank) + 1
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        last: list[int] = [-1] * len(raw)
        seams = self.seams
        for end, (t, n) in self.tokens.iter(raw.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - n
            if before < 0:
                last[end] = t
            elif (a := last[before]) >= 0:
                ok = seams.get(seam := a << 32 | t)
                if ok is None:
                    if len(seams) >= KEEP_SEAMS:
                        seams.clear()
                    ok = seams[seam] = self.compatible(a, t)
                if ok:
                    last[end] = t
        ids, end = [], len(raw) - 1
        while end >= 0:
            ids.append(last[end])
            end -= len(self.bytes[last[end]])
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        out = []
        for p in parts:
            if p in self.special:
                out.append(np.array([self.special[p]], "<u4").tobytes())
            else:
                out.extend(map(self.pieces.__getitem__, self.split.findall(p)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_MADE: dict[int, Bpe] = {}


def _tokenizer(spec) -> Bpe:
    """One per worker process and vocabulary."""
    key = hash(spec.value)
    if key not in _MADE:
        _MADE[key] = Bpe(spec.value)
    return _MADE[key]


def _broadcast(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) per row.

    ``path``: the vocabulary file, read by the driver.  A null text is an empty
    text and has no ids.  Rows are independent: repeated rows stay, columns not
    in ``keep`` are not read, an empty table gives an empty table.
    """
    spec = _broadcast(docs, path)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for b in parts(batches):
            ids = [bpe.encode(t.as_py() or "") for t in b.column("__text")]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, pa.array(ids, pa.binary())], [*keep, "n_tokens", "ids"])

    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids", "binary")
    return rows.mapInArrow(frugal(scan), schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text`` for rows of ``ids_col``; special tokens come out as their text, null ids as an empty text."""
    spec = _broadcast(encoded, path)
    rows = encoded.select(*keep, F.col(ids_col).alias("__ids"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for b in parts(batches):
            text = pa.array([bpe.decode(x.as_py() or b"") for x in b.column("__ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], [*keep, "text"])

    return rows.mapInArrow(frugal(scan), encoded.select(*keep).schema.add("text", "string"))
