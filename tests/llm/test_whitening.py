"""Whitening against exact fractions and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from feedline.llm import whitening as W
from feedline.llm.queries import QUERIES

CLASH = ["row", "dim", "x", "white", "deviation", "component", "n"]


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "k") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(parts)
    for c in CLASH:
        df = df.withColumn(c, df.label)
    return df


def brute(vectors):
    """n, sums, deviations, covariance of the fit list, in exact numbers."""
    xs = [tuple(math.floor(256 * c) for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    dev = [sum((n * x[i] - s[i]) ** 2 for i in range(d)) for x in xs]
    cov = [[sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    return xs, n, s, dev, cov


def hold(got, vectors, k=4):
    xs, n, s, dev, cov = brute(vectors)
    values, vecs = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vecs = values[::-1], vecs[:, ::-1]
    rank = sum(values > 1e-9 * values[0])
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    away = np.array([[float(Fraction(x[i]) - Fraction(s[i], n)) for i in range(len(s))] for x in xs])
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, min(k, rank) + 1))
    for c, rows in by.items():
        rows.sort(key=lambda r: r.row.vec_id)
        e = values[c - 1]
        assert [r.row.vec_id for r in rows] == list(range(len(vectors)))
        assert all(r.n == n and r.deviation == dev[r.row.vec_id] for r in rows)
        assert all(abs(r.explained - e / trace) < 1e-9 and r.identity_error < 1e-9 for r in rows)
        mine = np.array([r.whitened for r in rows])
        gaps = [abs(e - values[j]) for j in range(len(values)) if j != c - 1]
        if min(gaps) > 1e-6 * values[0]:  # else the basis is free
            want = away @ vecs[:, c - 1] / math.sqrt(e)
            want *= np.sign(want @ mine)
            assert np.abs(want - mine).max() < 1e-6


def test_equals_exact_covariance(spark):
    rng = np.random.default_rng(3)
    vectors = [list(v) for v in rng.normal(size=(120, 9)) @ np.diag(np.arange(1, 10) / 9)]
    vectors += vectors[:20] + [[0.0] * 9, [-0.0] * 9]
    hold(W.whiten(frame(spark, vectors)).collect(), vectors)


def test_bad_rows_are_dropped_and_lengths_agree(spark):
    good = [[0.1, 0.9, 0.3], [0.5, -0.2, 0.1], [0.2, 0.2, 0.7], [-1.0, 0.4, 0.0], [0.3, 0.3, 0.3]]
    bad = [None, [], [None, 1.0, 2.0], [float("nan"), 1, 1], [float("inf"), 0, 0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    df = frame(spark, good + bad)
    got = W.whiten(df, keep=("vec_id", *CLASH)).collect()
    hold(got, good)
    assert all(r.row[c] == "k" for r in got for c in CLASH)


def test_empty_single_and_equal(spark):
    assert W.whiten(frame(spark, [[1.0, 2.0]]).filter("false")).count() == 0
    assert W.whiten(frame(spark, [None, []])).count() == 0
    assert W.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0


def test_rank_and_equal_eigenvalues(spark):
    square = [[1, 1, 0.5], [1, -1, 0.5], [-1, 1, 0.5], [-1, -1, 0.5]]
    got = W.whiten(frame(spark, square)).collect()
    hold(got, square)
    white = {c: np.array([r.whitened for r in sorted(got, key=lambda r: r.row.vec_id) if r.component == c]) for c in (1, 2)}
    assert abs(white[1] @ white[2]) < 1e-12 and abs(white[1] @ white[1] - 4) < 1e-12


def test_huge_entries(spark):
    vectors = [[1e15, 2.0, 0.5], [3e12, -7e14, 1.0], [1e18, 1e30, -1e300], [5.0, 6.0, 7.0]]
    got = W.whiten(frame(spark, vectors)).collect()
    assert len({r.component for r in got}) == 3 and all(math.isfinite(r.whitened) for r in got)
    top = (1 << 63) - 1
    xs = [[min(max(math.floor(256 * c), -top - 1), top) for c in v] for v in vectors]
    s = [sum(x[i] for x in xs) for i in range(3)]
    dev = [sum((4 * x[i] - s[i]) ** 2 for i in range(3)) for x in xs]
    for r in got:
        assert r.deviation == (dev[r.row.vec_id] if dev[r.row.vec_id] <= top else None)


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (30, 7))
    for g in (x.T @ x, np.zeros((7, 7), np.int64), np.diag([4, 4, 4, 9, 0, 0, 1])):
        m = g.astype(object)
        poly = W.characteristic_polynomial(spark, m) if g.any() else [1] + [0] * 7
        # Faddeev-LeVerrier in integers
        want, b = [1], np.zeros((7, 7), object)
        for k in range(1, 8):
            b = m.dot(b) + want[-1] * np.eye(7, dtype=int).astype(object)
            want.append(-int(np.trace(m.dot(b))) // k)
        assert poly == want


def test_roots_with_multiplicity():
    # (t - 9)(t - 4)^3 (t - 1) t^2
    poly = [int(c) for c in np.poly([9, 4, 4, 4, 1, 0, 0]).round()]
    assert W.above(poly, 0) == 5 and W.above(poly, 4) == 1 and W.above(poly, 3) == 4
    fine = [c << (40 * i) for i, c in enumerate(poly)]
    got = W.largest_roots(fine, 6, 20 << 40)
    assert [round(r / 2 ** 40) for r, _ in got] == [9, 4, 4, 4, 1] and all(abs(r - (round(r / 2 ** 40) << 40)) <= 1 for r, _ in got)
    assert len({g for _, g in got}) == 3


@pytest.mark.parametrize("dim", [5, 40])
def test_close_eigenvalues_give_orthogonal_components(dim):
    rng = np.random.default_rng(dim)
    x = rng.integers(-9, 9, (60, dim)).astype(object)
    m = x.T.dot(x) * 1000
    m = m + m.T
    poly = W.chinese({int(p): W.hessenberg_polynomials(m, np.array([p]))[0].tolist() for p in W.primes(W.coefficient_bits(m))})
    trace = int(np.trace(m))
    scale = W.BITS - trace.bit_length()
    roots = W.largest_roots([c << (scale * i) for i, c in enumerate(poly)], 4, (trace << scale) + 1)
    v = np.array(W.eigenvectors(m, roots, scale))
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-14
    values = np.array([r / 2 ** scale for r, _ in roots])
    assert np.abs(m.astype(float) @ v.T - v.T * values).max() < 1e-11 * values[0]


def test_packing():
    x = np.array([[1, -2], [40000, 5], [1 << 40, -(1 << 62)]])
    col = pa.array(W.pack(x), pa.binary())
    assert (W.unpack(col, 2) == x).all() and (W.unpack(col.slice(1), 2) == x[1:]).all()


def test_query_on_table(spark):
    base = "/root/testdata/sf0.001"
    got = QUERIES["op11_embedding_whitening"](spark, base).collect()
    rows = [r for r in spark.read.parquet(f"{base}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x = np.array([[math.floor(256 * c) for c in r.embedding] for r in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    dev = {r.vec_id: int(v) for r, v in zip(rows, ((n * x - s) ** 2).sum(axis=1))}
    assert len(got) == 4 * len(rows) and all(r.n == n and r.deviation == dev[r.vec_id] for r in got)
    values, vecs = np.linalg.eigh(np.cov(fit.T, bias=True))
    for c in range(1, 5):
        mine = {r.vec_id: r.whitened for r in got if r.component == c}
        want = (x - s / n) @ vecs[:, -c] / math.sqrt(values[-c])
        order = np.array([mine[r.vec_id] for r in rows])
        assert np.abs(order - want * np.sign(want @ order)).max() < 1e-8
    assert max(r.identity_error for r in got) < 1e-9
