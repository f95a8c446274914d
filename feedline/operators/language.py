"""Language detection as a Spark job (X4's default detector).

Model: multinomial naive Bayes over character 1..3-grams of normalised text
(lower-cased, every run of non-letters -> one space).

fit (``fit_profile``), over labelled documents:
    count grams inside each task, by slices of its texts -> sum per (lang, gram) [partial aggregation]
    -> one row per gram: array of log P(gram | lang), Laplace-smoothed,
       languages in sorted order  (the "profile")
    + per-language log prior.

detect (``detect``), over any text column, whole texts:
    the profile, when its counted size is under the limit, goes to the Python
    workers as sorted arrays; each Arrow batch is scored by numpy inside its
    rows (grams as packed code points, looked up by binary search), so there
    is no row per gram, no shuffle and no join back;
    a larger profile is joined on the gram instead: only the key is carried,
    sums are partial per task before the one shuffle (AQE splits a hot gram's
    partition).
    -> log prior added, arg-max and softmax probability.
Grams never seen in training are ignored for every language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_texts, small
from ..session import ensure_checkpoint_dir
from .sizing import DEFAULT_BROADCAST_LIMIT, broadcast_rows_if_bounded

MAX_N = 3
#: Distinct grams that a task counts before it sends them, and those it sends at a time.
HELD_GRAMS = 1 << 20
OUT_ROWS = 1 << 14


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\p{L}]+", " ")


def grams(text: Column, max_n: int = MAX_N) -> Column:
    """Array of all overlapping character 1..max_n-grams of ``text``.

    One regex scan per n with a capturing look-ahead, ``(?=(.{n}))``: every
    position yields the n characters that start there.  Linear in the text
    length and free of per-element lambdas (which Spark interprets, ~3x
    slower here; ``substring`` at an offset would even be quadratic).
    """
    return F.concat(*[F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), 1)
                      for n in range(1, max_n + 1)])


def explode_grams(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """One row per (kept columns, gram) of the normalised ``text``."""
    c = df.select(*keep, normalise(text).alias("__t"))
    return c.select(*keep, F.explode(grams(F.col("__t"))).alias("gram"))


@dataclass
class Profile:
    langs: list[str]
    priors: list[float]          # log prior per language, same order as langs
    table: DataFrame             # (gram string, lp array<double>)
    rows: int                    # counted size of ``table``
    limit: int = DEFAULT_BROADCAST_LIMIT

    @property
    def row_bytes(self) -> int:
        return 48 + 8 * len(self.langs)

    def fits(self) -> bool:
        return self.rows * self.row_bytes <= self.limit

    def join_side(self) -> DataFrame:
        """The profile as a join side: broadcast only when its counted size fits."""
        return broadcast_rows_if_bounded(self.table, self.rows, self.row_bytes, self.limit)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted gram codes and their log probabilities (only for a profile that fits)."""
        t = self.table.toArrow()
        code = np.array([_code(g) for g in t.column("gram").to_pylist()], np.uint64)
        lp = np.array(t.column("lp").to_pylist(), np.float64).reshape(len(code), len(self.langs))
        order = np.argsort(code)
        return code[order], lp[order]


def _code(gram: str) -> int:
    """A gram of at most three code points as one integer: 21 bits each."""
    c = 0
    for ch in gram:
        c = c << 21 | ord(ch)
    return c


def _codes(points: np.ndarray, n: int) -> np.ndarray:
    """Codes of all grams of ``n`` code points."""
    code = points[:len(points) - n + 1].copy()
    for i in range(1, n):
        code = (code << np.uint64(21)) | points[i:len(points) - n + 1 + i]
    return code


def _summed(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two counts of codes as one."""
    code, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    times = np.zeros(len(code), np.int64)
    np.add.at(times, at, np.concatenate([m, n]))
    return code, times


def _gram(code: int, n: int) -> str:
    return "".join(chr(code >> 21 * (n - 1 - i) & 0x1FFFFF) for i in range(n))


def _row_scores(text: str, code: np.ndarray, lp: np.ndarray) -> np.ndarray | None:
    """Sums of log probabilities over the known grams of a normalised text; None without any."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total, known = np.zeros(lp.shape[1]), 0
    for n in range(1, min(MAX_N, len(points)) + 1):
        found, times = np.unique(_codes(points, n), return_counts=True)
        at = np.minimum(np.searchsorted(code, found), max(len(code) - 1, 0))
        hit = code[at] == found if len(code) else np.zeros(len(found), bool)
        total += times[hit] @ lp[at[hit]]
        known += int(hit.sum())
    return total if known else None


def fit_profile(docs: DataFrame, text: str = "text", label: str = "lang") -> Profile:
    """Train on labelled documents (whole texts)."""
    ensure_checkpoint_dir(docs.sparkSession)
    docs = docs.filter(F.col(label).isNotNull())

    def count(batches):
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(lang: str, n: int, code: np.ndarray, times: np.ndarray) -> None:
            parts = held.setdefault((lang, n), [])
            parts.append((code, times))
            # like the carries of a counter: every part has at least twice the codes of the next
            while len(parts) > 1 and len(parts[-2][0]) < 2 * len(parts[-1][0]):
                parts[-2:] = [_summed(*parts[-2], *parts[-1])]

        def flush():
            for (lang, n), parts in held.items():
                code, times = parts[0]
                for more in parts[1:]:
                    code, times = _summed(code, times, *more)
                for lo in range(0, len(code), OUT_ROWS):
                    some = code[lo:lo + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([_gram(c, n) for c in some.tolist()], pa.string()),
                                                      pa.array(times[lo:lo + OUT_ROWS], pa.int64())], ["lang", "gram", "n"])
            held.clear()

        for b in small(batches, "t"):
            of: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(b.column("lang").to_pylist(), b.column("t").to_pylist()):
                if t:
                    of.setdefault(lang, []).append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
            for lang, points in of.items():
                for n in range(1, MAX_N + 1):
                    codes = [_codes(p, n) for p in points if len(p) >= n]
                    if codes:
                        add(lang, n, *np.unique(np.concatenate(codes), return_counts=True))
            if sum(len(code) for parts in held.values() for code, _ in parts) > HELD_GRAMS:
                yield from flush()
        yield from flush()

    # Small driver-side facts: one row per language (reads the label column only).
    n_docs = {r[0]: r[1] for r in docs.groupBy(label).agg(F.count(F.lit(1))).collect()}
    langs = sorted(n_docs)
    d = docs.select(F.col(label).alias("lang"), F.col(text))
    # Grams are counted inside each task, a slice of its texts at a time, so a task
    # sends one row per gram and language; one aggregation gives one row per gram with its count
    # in every language, materialised in the shared checkpoint folder: the model.
    counts = d.select("lang", normalise(F.col(text)).alias("t")).mapInArrow(count, "lang string, gram string, n long")
    by_gram = (counts.groupBy("gram").pivot("lang", langs).agg(F.sum("n"))
               .fillna(0, subset=langs)).checkpoint()
    stats = by_gram.agg(F.count(F.lit(1)).alias("vocab"), *[F.sum(F.col(l)).alias(l) for l in langs]).first()
    vocab = stats["vocab"]
    total_docs = sum(n_docs.values())
    priors = [math.log(n_docs[l] / total_docs) for l in langs]
    lp = F.array(*[F.log((F.col(l).cast("double") + F.lit(1.0)) / F.lit(float(stats[l] + vocab)))
                   for l in langs])
    return Profile(langs, priors, by_gram.select("gram", lp.alias("lp")), int(vocab))


def _joined_scores(df: DataFrame, profile: Profile, text: Column, key: str) -> DataFrame:
    """(key, scores array) by joining grams with the profile: the way for a profile that does not fit a worker."""
    k = len(profile.langs)
    grams_of = explode_grams(df.select(F.col(key).alias("__k"), text.alias("__t")), F.col("__t"), ["__k"])
    j = grams_of.join(profile.join_side(), "gram")
    sums = j.groupBy("__k").agg(*[F.sum(F.col("lp")[i]).alias(f"__s{i}") for i in range(k)])
    return sums.select(F.col("__k").alias(key), F.array(*[F.col(f"__s{i}") for i in range(k)]).alias("__scores"))


def with_scores(df: DataFrame, profile: Profile, text: Column, key: str) -> DataFrame:
    """``df`` with ``__scores``: per language the log likelihood of ``text`` (null without a known gram)."""
    if not profile.fits():
        return df.join(_joined_scores(df, profile, text, key), key, "left")
    sent = df.sparkSession.sparkContext.broadcast(profile.arrays())  # at most ``limit`` bytes

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code, lp = sent.value
        return map_texts(texts, lambda t: None if t is None else _row_scores(t, code, lp), pa.list_(pa.float64()))

    return df.withColumn("__scores", score(normalise(text)))


def detect(df: DataFrame, profile: Profile, text: Column, key: str,
           lang_col: str = "detected_lang", prob_col: str = "detected_prob") -> DataFrame:
    """Add (lang, prob) of the most likely language of ``text`` to every row of ``df``.

    Rows whose text has no known gram get null (detection failed).  ``key``
    names a unique column, used only where the profile is too large to send.
    """
    k = len(profile.langs)
    scored = with_scores(df, profile, text, key)
    scores = [F.col("__scores")[i] + F.lit(profile.priors[i]) for i in range(k)]
    best = F.greatest(*scores) if k > 1 else scores[0]
    denom = sum((F.exp(s - best) for s in scores), F.lit(0.0))
    arg = F.lit(None).cast("string")
    for i in reversed(range(k)):  # first language wins ties
        arg = F.when(scores[i] == best, F.lit(profile.langs[i])).otherwise(arg)
    return scored.withColumns({lang_col: arg, prob_col: F.lit(1.0) / denom}).drop("__scores")


def language_scores(df: DataFrame, profile: Profile, text: Column, key: str) -> DataFrame:
    """(key, lang, log score) for every language -- the unnormalised posterior."""
    scored = with_scores(df.select(key, text.alias("__text")), profile, F.col("__text"), key).filter("__scores is not null")
    stacked = F.array(*[F.struct(F.lit(lang).alias("lang"), (F.col("__scores")[i] + F.lit(profile.priors[i])).alias("score"))
                        for i, lang in enumerate(profile.langs)])
    return scored.select(key, F.explode(stacked).alias("x")).select(key, "x.lang", "x.score")
