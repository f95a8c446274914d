"""Scoring texts with a Katz backoff model learned from the same table.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end
token behind each text.  The model is a bigram model over the words of the
learned rows, one class for all other words, and the end:

* Good-Turing: n-grams seen ``r <= 5`` times count ``d_r r``, with Katz's ``d_r`` from
  the numbers of n-grams seen ``r`` and ``r + 1`` times; where these give no valid
  discounts (small tables) ``r - D`` with ``D = n_1 / (n_1 + 2 n_2)`` instead.
* Words: what the discounts free goes to the class of other words.  Where nothing
  is freed, the class counts as one occurrence more.
* Bigrams: what the discounts of a context free goes to the words not seen behind
  it, in proportion to their own probabilities; the weight divides by what the
  words seen there do not take, so each context's probabilities sum to 1 exactly.
  A context whose words were all seen often counts one occurrence more.  Behind a
  word that is not learned the words' own probabilities hold.

How it runs.  Tasks read texts into blocks of about a million tokens: a block is
one row with the hashes of its distinct words and its texts as positions in them,
kept in a table bucketed by block, which the joins below read in place.

1. Each block asks for its distinct words, dealt to parts by hash; a part adds up
   the learned counts, numbers the words, stores them and answers.
2. Each block asks for its distinct bigrams, dealt by their first word; a part adds
   up counts, stores them and answers with the count and, for bigrams not seen,
   what the backoff weight needs.  First words with more than half a part's share of
   all tokens are dealt by second words too; their sums (two rows a part at most)
   are put together on the driver and shared.
3. Each block evaluates its tokens: the bigram, else the weight times the word.

So a hot word or bigram is one entry a block, parts follow from counted entries,
and nothing that grows with the corpus is broadcast.  Words are told apart by
64-bit hashes.

A null text is an empty one: its only token is the end.  Rows that repeat count
and are scored each.  A null in the column of learned rows counts as false.  With
no learned row every token has probability 1, as it has for the base score.  An
empty table gives an empty one.  Other columns are kept where named in ``keep``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import frugal, from_planes, mix64, planes, runs, slices, text_bytes, whole_groups
from .passages import word_hashes
from .scratch import Scratch

K = 5  #: counts up to this are discounted
OTHER, START = 0, 1  #: numbers of the class of words that are not learned, and of the place before a text
END = np.uint64(0x6A09E667F3BCC909)  #: hash of the end token


@dataclass(frozen=True)
class Sizes:
    """Tokens of a block, and entries of a part."""

    block: int = 1 << 20
    part: int = 1 << 20


# ---------------------------------------------------------------- the model

def discounts(n: list[int]) -> np.ndarray:
    """Factors of counts 0 to K + 1 (the last for all above K), given how many n-grams were seen 1, 2, ..., K + 1 times."""
    d = np.ones(K + 2)
    n = [0, *map(int, n)]
    if all(n[1:]):
        last = (K + 1) * n[K + 1] / n[1]
        good = [((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if last < 1 else 0.0 for r in range(1, K + 1)]
        if all(0 < x < 1 for x in good):
            d[1:K + 1] = good
            return d
    less = min(max(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.1), 0.9)
    d[1:K + 1] = [(r - less) / r for r in range(1, K + 1)]
    return d


@dataclass(frozen=True)
class Words:
    """Probabilities of single words from their learned counts."""

    tokens: int
    distinct: int
    d: np.ndarray
    freed: float

    @classmethod
    def of(cls, stats: list[int]) -> Words:
        distinct, tokens, *n = map(int, stats)
        d = discounts(n)
        return cls(tokens, distinct, d, float(sum(n[r - 1] * r * (1 - d[r]) for r in range(1, K + 1))))

    def p(self, c: np.ndarray) -> np.ndarray:
        """Of words seen ``c`` times; 0 is the class of all others."""
        if not self.tokens:
            return np.ones(len(c))
        all_, other = (self.tokens, self.freed) if self.freed > 0 else (self.tokens + 1, 1.0)
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c, other) / all_

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def backed_off(c: np.ndarray, total: np.ndarray, low: np.ndarray, taken: np.ndarray, own: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probabilities of bigrams seen ``c`` times.

    ``total``: occurrences of the context, one more where no count is up to K;
    ``low``: per context how many words were seen 1 to K times (one row per r);
    ``taken``: sum of the own probabilities of words seen behind it; ``own``: the
    word's.  The last three are read only where ``c`` is 0.
    """
    freed = sum(low[r - 1] * (r * (1 - d[r])) for r in range(1, K + 1))
    freed = np.where(low.sum(axis=0) > 0, freed, 1.0) / np.maximum(total, 1)
    weight = np.where(total > 0, freed / np.maximum(1 - taken, 1e-300), 1.0)
    return np.where(c > 0, d[np.minimum(c, K + 1)] * c / np.maximum(total, 1), weight * own)


# ---------------------------------------------------------------- packed rows

def pack(*cols: tuple[np.ndarray, int]) -> bytes:
    """Columns of 8-byte numbers, the lowest bytes of each that are asked for, compressed together."""
    return pa.compress(b"".join(planes(np.ascontiguousarray(c).view(np.int64), w) for c, w in cols if len(c)), "zstd", asbytes=True)


def unpack(data: pa.Buffer, n: int, *widths: int) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, np.int64) for _ in widths]
    raw, out, at = memoryview(pa.decompress(data, n * sum(widths), "zstd")), [], 0
    for w in widths:
        out.append(from_planes(raw[at:at + n * w], w, np.int64))
        at += n * w
    return out


WORD_ASKED, WORD_TOLD = (8, 5), (5, 6)  #: hash, learned count; number, learned count
PAIR_ASKED = (6, 5, 5, 6, 1)  #: step of first word, second word, learned count, second word's learned count, split
PAIR_TOLD = (5, 6, *[5] * K, 8)  #: count, total, words seen 1 to K times, what they take


def dealt(part: np.ndarray, block: int, widths: tuple[int, ...], *cols: np.ndarray) -> pa.RecordBatch:
    """Rows of a block's entries, which come ordered by part."""
    rows = [(int(part[s]), block, int(e - s), pack(*((c[s:e], w) for c, w in zip(cols, widths)))) for s, e in zip(*runs(part))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "block", "n", "data"])


ASKED = "part int, block long, n long, data binary"
#: Answers to blocks (kind 0), numbers of a part (1), its stored entries (2), sums of split first words (3).
TOLD = "kind int, part int, block long, n long, data binary, stats array<long>, taken double"


def told(kind: int, part: int, block: int = -1, n: int = 0, data: bytes | None = None, stats: list[int] | None = None, taken: float = 0.0) -> tuple:
    return kind, part, block, n, data, stats, taken


def _told_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.float64()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in TOLD.split(", ")])


def _parts(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...]) -> Iterator[tuple[int, list[int], list[int], list[list[np.ndarray]]]]:
    """Part, blocks and sizes of its rows, and their unpacked columns."""
    for table in whole_groups(batches, "part"):
        for s, e in zip(*runs(table.column("part").to_numpy())):
            t = table.slice(s, e - s)
            n = t.column("n").to_pylist()
            yield t.column("part")[0].as_py(), t.column("block").to_pylist(), n, [unpack(d.as_buffer(), k, *widths) for d, k in zip(t.column("data"), n)]


# ---------------------------------------------------------------- blocks

def read_blocks(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    task, nth, held, tokens = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        buf, offs = text_bytes(b.column("text"))
        for lo, hi in slices(offs, 1 << 20):
            h, _, _, w = word_hashes(buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
            stream = np.insert(h, w[1:], END)
            held.append((b.column("row").slice(lo, hi - lo), b.column("learn").slice(lo, hi - lo).to_numpy(zero_copy_only=False), np.diff(w) + 1, stream))
            tokens += len(stream)
            if tokens >= sizes.block:
                yield _block(task << 32 | nth, held)
                nth, held, tokens = nth + 1, [], 0
    if held:
        yield _block(task << 32 | nth, held)


def _block(number: int, held: list[tuple]) -> pa.RecordBatch:
    rows = pa.concat_arrays([x[0] for x in held])
    learn, size, stream = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
    words, at = np.unique(stream, return_inverse=True)
    seen = np.bincount(at[np.repeat(learn, size)], minlength=len(words))
    cols = {"block": pa.array([number], pa.int64()), "rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            "n_texts": [len(rows)], "n_learned": [int(learn.sum())], "n_tokens": [len(stream)], "n_words": [len(words)],
            "texts": pa.array([pack((size, 6), (learn.astype(np.int64), 1))], pa.binary()), "words": pa.array([pack((words, 8), (seen, 5))], pa.binary()),
            "stream": pa.array([pack((at.astype(np.int64), 4))], pa.binary())}
    return pa.RecordBatch.from_pydict(cols)


BLOCK = "n_texts long, n_learned long, n_tokens long, n_words long, texts binary, words binary, stream binary"


def word_parts(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each of a block's words, and their order by it."""
    part = ((words.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    return part, np.argsort(part, kind="stable")


def ask_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, n, data in zip(*(b.column(c) for c in ("block", "n_words", "words"))):
            words, seen = unpack(data.as_buffer(), n.as_py(), 8, 5)
            part, order = word_parts(words, parts)
            yield dealt(part[order], block.as_py(), WORD_ASKED, words[order], seen[order])


def tell_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for part, blocks, n, cols in _parts(batches, WORD_ASKED):
        words, seen = (np.concatenate([c[i] for c in cols]) for i in (0, 1))
        found, of = np.unique(words, return_inverse=True)
        count = np.bincount(of, seen, len(found)).astype(np.int64)
        rank = np.lexsort((found, -count))  # often seen words get small numbers
        number = np.zeros(len(found), np.int64)
        number[rank] = 2 + part + parts * np.arange(len(found))
        number[count == 0] = OTHER
        known = count > 0
        out = [told(1, part, stats=[int(known.sum()), int(count.sum()), *(int((count == r).sum()) for r in range(1, K + 2))]),
               told(2, part, n=int(known.sum()), data=pack((found[known], 8), (number[known], 5), (count[known], 6)))]
        number, count = number[of], count[of]
        at = 0
        for block, k in zip(blocks, n):
            out.append(told(0, part, block, k, pack(*((c[at:at + k], w) for c, w in zip((number, count), WORD_TOLD)))))
            at += k
        yield _told_batch(out)


def _answers(told_: pa.Scalar, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Answers to one block, in the order of parts."""
    rows = sorted(told_.as_py() or [], key=lambda r: r["part"])
    cols = [unpack(r["data"], r["n"], *widths) for r in rows]
    return [np.concatenate([c[i] for c in cols]) if cols else np.zeros(0, np.int64) for i in range(len(widths))]


class Block:
    """A block with the numbers and learned counts of its words, and its distinct bigrams in the order they are asked for."""

    def __init__(self, r: dict, tokens: int, learned: int, word_part_count: int, parts: int):
        self.size, learn = unpack(r["texts"].as_buffer(), r["n_texts"].as_py(), 6, 1)
        words, _ = unpack(r["words"].as_buffer(), r["n_words"].as_py(), 8, 5)
        (self.at,) = unpack(r["stream"].as_buffer(), r["n_tokens"].as_py(), 4)
        d = len(words)
        _, order = word_parts(words, word_part_count)
        got = _answers(r["told_words"], WORD_TOLD)
        number, count = np.full(d + 1, START, np.int64), np.full(d + 1, learned, np.int64)
        number[order], count[order] = got
        self.number, self.count = number, count
        self.start = np.cumsum(self.size) - self.size
        one = np.arange(d + 1)
        other = np.flatnonzero(number == OTHER)
        one[other] = other[:1]  # all other words are one class
        self.w = one[self.at]
        first = np.empty_like(self.w)
        first[1:] = self.w[:-1]
        first[self.start] = d
        self.paired = number[first] != OTHER
        keys, self.of = np.unique((first * (d + 1) + self.w)[self.paired], return_inverse=True)
        self.seen = np.bincount(self.of, np.repeat(learn, self.size)[self.paired], len(keys)).astype(np.int64)
        self.first, self.second = keys // (d + 1), keys % (d + 1)
        a, b = number[self.first], number[self.second]
        share = count[self.first].astype(np.float64) * (2 * parts) / max(tokens, 1)
        self.split = share > 1
        salt = np.where(self.split, b % np.maximum(np.ceil(share), 1).astype(np.int64), 0)
        self.part = (mix64((a * 0x3C79AC49 + salt).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        self.order = np.lexsort((b, a, self.part))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i] for c in b.schema.names}


def ask_pairs(batches: Iterator[pa.RecordBatch], tokens: int, learned: int, word_part_count: int, parts: int) -> Iterator[pa.RecordBatch]:
    for r in _each(batches):
        x = Block(r, tokens, learned, word_part_count, parts)
        o = x.order
        if not len(o):
            continue
        part, a = x.part[o], x.number[x.first[o]]
        step = np.diff(a, prepend=0)
        for s in runs(part)[0]:
            step[s] = a[s]  # a row starts with its own number
        yield dealt(part, r["block"].as_py(), PAIR_ASKED, step, x.number[x.second[o]], x.seen[o], x.count[x.second[o]], x.split[o].astype(np.int64))


def tell_pairs(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    for part, blocks, n, cols in _parts(batches, PAIR_ASKED):
        a = np.concatenate([np.cumsum(c[0]) for c in cols])
        b, seen, own, split = (np.concatenate([c[i] for c in cols]) for i in (1, 2, 3, 4))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new = new_a | np.concatenate([[True], b[1:] != b[:-1]])
        s = np.flatnonzero(new)
        count = np.add.reduceat(seen[order], s)
        p = np.where(count > 0, words.p(own[order][s]), 0.0)
        of_first = np.cumsum(new_a) - 1
        at = np.flatnonzero(new_a[s])
        total, taken = np.add.reduceat(count, at), np.add.reduceat(p, at)
        low = np.array([np.add.reduceat(count == r, at, dtype=np.int64) for r in range(1, K + 1)])
        known = count > 0
        out = [told(1, part, stats=[int((count == r).sum()) for r in range(1, K + 2)]),
               told(2, part, n=int(known.sum()), data=pack((a[s][known], 5), (b[s][known], 5), (count[known], 5)))]
        heads = s[at]
        for i in np.flatnonzero(split[order][heads]):
            out.append(told(3, part, stats=[int(a[heads[i]]), int(total[i]), *map(int, low[:, i])], taken=float(taken[i])))
        total = total + ((total > 0) & (low.sum(axis=0) == 0))
        # back to the entries as they were asked for
        back = np.empty(len(a), np.int64)
        back[order] = np.arange(len(a))
        count, f = count[(np.cumsum(new) - 1)[back]], of_first[back]
        missed = count == 0
        answer = [count, total[f], *(np.where(missed, x[f], 0) for x in low), np.where(missed, taken[f], 0.0)]
        j = 0
        for block, k in zip(blocks, n):
            out.append(told(0, part, block, k, pack(*((c[j:j + k], w) for c, w in zip(answer, PAIR_TOLD)))))
            j += k
        yield _told_batch(out)


def evaluate(batches: Iterator[pa.RecordBatch], words: Words, d: np.ndarray, split: tuple[np.ndarray, ...], learned: int, word_part_count: int, parts: int) -> Iterator[pa.RecordBatch]:
    heads, totals, lows, takens = split
    for r in _each(batches):
        x = Block(r, words.tokens, learned, word_part_count, parts)
        count, total, *low, taken = _answers(r["told_pairs"], PAIR_TOLD)
        low, taken = np.array(low), taken.view(np.float64)
        o = x.order
        if len(heads):  # sums of first words that several parts hold
            a = x.number[x.first[o]]
            i = np.minimum(np.searchsorted(heads, a), len(heads) - 1)
            hot = heads[i] == a
            total, taken, low = np.where(hot, totals[i], total), np.where(hot, takens[i], taken), np.where(hot, lows[:, i], low)
        own = words.p(x.count[:-1])
        p = np.empty(len(o))
        p[o] = backed_off(count, total, low, taken, own[x.second[o]], d)
        score = np.log10(own)[x.w]
        score[x.paired] = np.log10(p)[x.of]
        known = x.number[x.at] != OTHER
        sums = [np.add.reduceat(v, x.start) for v in (known.astype(np.int64), words.base(x.count[:-1])[x.at], score)]
        yield pa.RecordBatch.from_arrays([r["rows"].values, *map(pa.array, (x.size, sums[0], np.full(len(x.size), words.tokens), *sums[1:]))],
                                         ["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_stats(told_: DataFrame, n: int) -> list[int]:
    got = told_.filter("kind = 1").agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n))).first()
    return [v or 0 for v in got]


def _to_blocks(told_: DataFrame, name: str) -> DataFrame:
    """One row per block with its answers, which are no more than its own entries."""
    return told_.filter("kind = 0").groupBy("block").agg(F.collect_list(F.struct("part", "n", "data")).alias(name))


def score(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """``row`` (a struct of ``keep``) and ``SCORES`` of every text, by a model of the rows where ``learn`` holds."""
    return learn_and_score(docs, learn, keep, text_col, sizes)[0]


def learn_and_score(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                    sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scores of ``score`` and the stored tables: one row per part with its packed words (hash, number, count)
    and one with its packed bigrams (numbers, count)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), *T._parse_datatype_string(BLOCK)])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.write_bucketed(rows.mapInArrow(frugal(lambda x: read_blocks(x, sizes)), shape), f"katz_{uuid.uuid4().hex}", "block", buckets)
    seen = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens", "n_learned"))).first()
    word_parts_, parts = (max(1, -(-int(n) // sizes.part)) for n in seen[:2])
    learned = int(seen[2])

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition("part").sortWithinPartitions("part")

    asked = blocks.select("block", "n_words", "words").mapInArrow(frugal(lambda x: ask_words(x, word_parts_)), ASKED)
    told_words = scratch.write(by_part(asked).mapInArrow(frugal(lambda x: tell_words(x, word_parts_)), TOLD), "words")
    words = Words.of(_sum_stats(told_words, K + 3))
    tokens = words.tokens
    known = blocks.join(_to_blocks(told_words, "told_words"), "block")
    asked = known.drop("rows").mapInArrow(frugal(lambda x: ask_pairs(x, tokens, learned, word_parts_, parts)), ASKED)
    told_pairs = scratch.write(by_part(asked).mapInArrow(frugal(lambda x: tell_pairs(x, words)), TOLD), "pairs")
    d = discounts(_sum_stats(told_pairs, K + 1))
    split = _split_sums(told_pairs)
    both = known.join(_to_blocks(told_pairs, "told_pairs"), "block", "left")
    scored = both.mapInArrow(frugal(lambda x: evaluate(x, words, d, split, learned, word_parts_, parts)), T.StructType([rows.schema["row"], *T._parse_datatype_string(SCORES)]))
    return scored, told_words.filter("kind = 2").select("part", "n", "data"), told_pairs.filter("kind = 2").select("part", "n", "data")


def _split_sums(told_pairs: DataFrame) -> tuple[np.ndarray, ...]:
    """First words that several parts hold, with totals, low counts and what is taken: at most two a part."""
    cols = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(1, K + 2)]
    got = told_pairs.filter("kind = 3").groupBy(F.col("stats")[0].alias("a")).agg(*cols, F.sum("taken").alias("taken")).orderBy("a").collect()
    total = np.array([r.s1 for r in got], np.int64)
    low = np.array([[r[f"s{i}"] for r in got] for i in range(2, K + 2)], np.int64).reshape(K, len(got))
    return np.array([r.a for r in got], np.int64), total + ((total > 0) & (low.sum(axis=0) == 0)), low, np.array([r.taken for r in got])
