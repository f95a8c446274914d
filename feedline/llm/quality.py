"""Quality classifier: hashed word and character n-gram vectors, averaged, softmax output.

A text's features are its words, its word pairs and its byte 4-grams, hashed
into ``buckets`` rows of an embedding table.  A text is the mean of its
features' vectors; a linear layer and a softmax give the probability of label 1.
The vectors and the layer are learned together by stochastic gradient descent
in numpy.  A word pair is hashed by the difference of its words' hashes, so
that all immediate repetitions share one feature.

Fit.  From at most ``max_rows`` labelled rows (those with the smallest hash of
their id), whose sparse feature counts, not texts, go to the driver: at most
``max_rows * buckets`` pairs of numbers.  Scoring covers every row and whole text:
the layer folds into one weight per bucket, so a text's score is a mean of looked-up weights.

A null text is an empty text; a text without a feature (empty) scores by the
bias alone.  Null or other labels than 0 and 1 are not learned.  Repeated rows
are scored each by itself.  Without rows of both classes every score is the
share of label 1 (0.5 without any row).  Neither id, language nor source is a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .batches import M1, M2, frugal, mix64, prefix_sums, slices, span_hashes, text_bytes, words

GRAM = 4


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    dim: int = 16
    steps: int = 800
    batch: int = 32
    rate: float = 60.0
    seed: int = 7
    max_rows: int = 2000


def features(buf: np.ndarray, offs: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and grams in turn: their buckets, text by text, and the n + 1 offsets into them."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    s, e, w = words(buf, offs)
    h = span_hashes(prefix_sums(buf), s, e)
    yield (h >> shift).astype(np.int64), w
    # the pair that a text's last word would make with the next text's first is left out
    inner = np.ones(max(len(h) - 1, 0), bool)
    inner[w[1:-1][(w[1:-1] > 0) & (w[1:-1] < len(h))] - 1] = False
    pair = mix64((h[1:] - h[:-1]) * M1 + np.uint64(1))[inner] >> shift
    yield pair.astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(np.diff(w) - 1, 0))])
    m = max(len(buf) - GRAM + 1, 0)
    b = buf.astype(np.uint64)
    g = b[:m].copy()
    for i in range(1, GRAM):
        g |= b[i:m + i] << np.uint64(8 * i)
    fits = np.ones(m, bool)
    for i in range(1, GRAM):
        at = offs[1:-1] - i
        fits[at[(at >= 0) & (at < m)]] = False
    g = (((g + M1) * M2) >> shift)[fits]
    yield g.astype(np.int64), np.concatenate([[0], np.cumsum(fits)])[np.minimum(offs, m)]


@dataclass
class Model:
    weight: np.ndarray  #: per bucket, float32
    bias: float

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for idx, at in features(buf, offs, len(self.weight)):
            sums = np.zeros(len(idx) + 1)
            np.cumsum(self.weight[idx], out=sums[1:])
            total += sums[at[1:]] - sums[at[:-1]]
            n += np.diff(at)
        z = self.bias + total / np.maximum(n, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def train(idx: np.ndarray, count: np.ndarray, offs: np.ndarray, label: np.ndarray, conf: Settings) -> Model:
    """SGD on texts given as sparse feature counts (``idx, count`` between ``offs``)."""
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or not len(label):
        return Model(np.zeros(conf.buckets, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng = np.random.default_rng(conf.seed)
    emb = ((rng.random((conf.buckets, conf.dim), np.float32) - 0.5) / conf.dim).astype(np.float32)
    out = (rng.standard_normal((conf.dim, 2)) * 0.1).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    total = np.add.reduceat(count, offs[:-1]) if len(count) else np.zeros(0)
    n, done = len(label), 0
    while done < conf.steps:
        for rows in np.array_split(rng.permutation(n), -(-n // conf.batch)):
            rate = conf.rate * max(0.0, 1 - done / conf.steps)
            done += 1
            size = offs[rows + 1] - offs[rows]
            at = np.repeat(offs[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            i = idx[at]
            part = (count[at] / np.repeat(total[rows], size))[:, None].astype(np.float32)
            hidden = np.add.reduceat(emb[i] * part, np.cumsum(size) - size)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            out -= 0.05 * rate * hidden.T @ p
            bias -= 0.05 * rate * p.sum(axis=0)
            np.subtract.at(emb, i, rate * np.repeat(back, size, axis=0) * part)
    return Model(emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, conf: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of ``labels(id_col, label_col)`` over the whole texts of ``docs``; only rows given here are learned."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    some = known.orderBy(F.xxhash64("__id"), "__id", "__label").limit(conf.max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(
        F.broadcast(some), "__id").select("__id", "__label", "__text")  # at most max_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_bytes(b.column("__text"))
            idx, n = [], []
            for i in range(b.num_rows):
                f = [f for f, _ in features(buf[offs[i]:offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), conf.buckets)]
                u, c = np.unique(np.concatenate(f), return_counts=True)
                idx.append(u.astype(np.int32))
                n.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("__id").cast(pa.string()), b.column("__label"), pa.array(idx, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))],
                ["id", "label", "idx", "n"])

    t = texts.mapInArrow(frugal(count), "id string, label int, idx array<int>, n array<int>").toArrow().combine_chunks()
    label = t.column("label").to_numpy()
    lists = t.column("idx").combine_chunks()
    if not len(label):
        return train(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), label, conf)
    filled = np.flatnonzero(np.diff(lists.offsets.to_numpy()) > 0)
    order = filled[np.argsort(t.column("id").to_numpy(zero_copy_only=False)[filled].astype(str), kind="stable")]
    lists, n = lists.take(pa.array(order)), t.column("n").combine_chunks().take(pa.array(order))
    return train(lists.flatten().to_numpy(), n.flatten().to_numpy().astype(np.float32),
                 np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64), label[order], conf)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, out: str = "score") -> DataFrame:
    """``keep`` columns (the id by default) and ``out``, the probability of label 1, of every row."""
    keep = keep or (id_col,)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one float per bucket
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    shared = text_col in keep and docs.schema[text_col].dataType.typeName() == "string"  # else the text goes along as a last column
    rows = kept if shared else docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    at = keep.index(text_col) if shared else len(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            buf, offs = text_bytes(b.column(at))
            parts = [m.score(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]) for lo, hi in slices(offs)]
            p = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], p], [*keep, out])

    return rows.mapInArrow(frugal(scan), StructType([*kept.schema, StructField(out, DoubleType())]))
