"""Katz backoff against a plain model in dictionaries, and exact normalisation."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feedline.llm import katz
from feedline.llm.queries import QUERIES

from .common import WORD, docs, odd_rows

SMALL = katz.Sizes(block=300, part=200)


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def discounts(counts):
    n = Counter(counts.values())
    k, d = katz.K, {}
    last = (k + 1) * n[k + 1] / n[1] if n[1] else 1
    if last < 1 and all(n[r] for r in range(1, k + 2)):
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) for r in range(1, k + 1)}
    if not d or not all(0 < x < 1 for x in d.values()):
        less = min(max(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.1), 0.9)
        d = {r: (r - less) / r for r in range(1, k + 1)}
    return lambda c: d.get(c, 1.0)


class Plain:
    def __init__(self, texts):
        self.c, self.cc = Counter(), Counter()
        self.behind = defaultdict(dict)
        for t in texts:
            prev = "<s>"
            for w in tokens(t):
                self.c[w] += 1
                self.cc[prev, w] += 1
                prev = ("w", w)
        for (a, w), n in self.cc.items():
            self.behind[a][w] = n
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d1, self.d2 = discounts(self.c), discounts(self.cc)
        self.freed = sum(n * (1 - self.d1(n)) for n in self.c.values())
        self.weights = {}

    def own(self, w):
        if not self.n:
            return 1.0
        total, other = (self.n, self.freed) if self.freed > 0 else (self.n + 1, 1)
        return self.d1(self.c[w]) * self.c[w] / total if w in self.c else other / total

    def p(self, a, w):
        seen = self.behind.get(a)
        if not seen:
            return self.own(w)
        total = sum(seen.values())
        total += all(n > katz.K for n in seen.values())
        if w in seen:
            return self.d2(seen[w]) * seen[w] / total
        if a not in self.weights:
            self.weights[a] = (1 - sum(self.d2(n) * n for n in seen.values()) / total) / (1 - sum(self.own(x) for x in seen))
        return self.weights[a] * self.own(w)

    def score(self, text):
        prev, total = "<s>", 0.0
        for w in tokens(text):
            total += math.log10(self.p(prev, w))
            prev = ("w", w)
        return total

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def corpus():
    rows = [(i, f"the {a} sat on the {b} . the {c} saw the {a}") for i, (a, b, c) in enumerate(
        [(x, y, z) for x in ("cat", "Dog", "cow") for y in ("mat", "rug", "sill") for z in ("boy", "girl", "zebra", "man", "Ox")])]
    # counts that give Good-Turing discounts
    rare = [f"r{n}_{k}" for n, many in ((1, 60), (2, 20), (3, 9), (4, 5), (5, 3), (6, 2)) for k in range(many) for _ in range(n)]
    rows += [(1000 + i, " ".join(rare[i::7])) for i in range(7)]
    return rows + [(2000 + i if r[0] is None else r[0] + 3000, r[1]) for i, r in enumerate(odd_rows())]


@pytest.mark.parametrize("sizes", [SMALL, katz.Sizes()])
def test_equals_plain_model(spark, sizes):
    rows = corpus()
    got = katz.score(docs(spark, rows), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True)), keep=("doc_id", "text", "score"), sizes=sizes).collect()
    plain = Plain([t for i, t in rows if not held(i)])
    assert sorted((r.row.doc_id, r.row.text or "") for r in got) == sorted((i, t or "") for i, t in rows)
    for r in got:
        t = r.row.text
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(w in plain.c for w in tokens(t)), plain.n)
        assert math.isclose(r.base_score, plain.base(t), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, plain.score(t), rel_tol=1e-9, abs_tol=1e-9)
        assert r.row.score == "x"


def test_contexts_sum_to_one():
    plain = Plain([t for _, t in corpus()])
    words = [*plain.c, "never seen"]
    assert abs(sum(plain.own(w) for w in words) - 1) < 1e-12
    for a in list(plain.behind)[:40] + ["<s>", ("w", "unknown")]:
        assert abs(sum(plain.p(a, w) for w in words) - 1) < 1e-9


def test_discounts():
    good = katz.discounts([60, 20, 9, 5, 3, 2])
    assert good[0] == good[-1] == 1 and all(0 < x < 1 for x in good[1:-1])
    assert katz.discounts([0] * 6)[1] == 0.5 and katz.discounts([4, 3, 0, 0, 0, 0])[2] == (2 - 0.4) / 2


def test_nothing_learned_and_empty_table(spark):
    df = docs(spark, odd_rows())
    got = katz.score(df, F.lit(None).cast("boolean")).collect()
    assert len(got) == len(odd_rows()) and all(r.score == 0 and r.base_score == 0 and r.train_tokens == r.n_known == 0 for r in got)
    assert katz.score(df.filter("false"), F.lit(True)).count() == 0


def test_hot_first_words_are_split(spark):
    rows = [(i, " ".join(f"of x{i * 37 + j}" for j in range(60))) for i in range(30)] + [(100, "of unseen of x5 x6"), (101, "of")]
    learn = F.col("doc_id") < 100
    scored, words, pairs = katz.learn_and_score(docs(spark, rows), learn, sizes=SMALL)
    plain = Plain([t for i, t in rows if i < 100])
    for r in scored.collect():
        assert math.isclose(r.score, plain.score(dict(rows)[r.row.doc_id]), rel_tol=1e-9)
    assert words.agg(F.sum("n")).first()[0] == plain.v and pairs.agg(F.sum("n")).first()[0] == len(plain.cc)
    assert pairs.agg(F.max("n")).first()[0] < 0.5 * len(plain.cc)


def test_blocks_are_joined_in_place(spark):
    scored = katz.score(docs(spark, odd_rows()), F.lit(True), sizes=SMALL)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.lower()


def test_query_equals_plain_model(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    plain = Plain([t for i, t in rows if not held(i)])
    got = QUERIES["op13_lm_scoring"](spark, base).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got[:40]:
        assert r.held_out == held(r.doc_id) and math.isclose(r.score, plain.score(texts[r.doc_id]), rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
