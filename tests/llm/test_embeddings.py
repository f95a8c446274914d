import numpy as np
import pytest

from feedline.llm.embedding_dedup import near_duplicates, settings
from feedline.llm.queries import QUERIES

from .common import components


def brute(rows, threshold=0.98):
    groups, n, linked = {}, [0] * len(rows), []
    for i, (d, v, label) in enumerate(rows):
        if d is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault((label, len(v)), []).append(i)
    for ids in groups.values():
        x = np.array([rows[i][1] for i in ids], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        a, b = np.nonzero(x @ x.T >= threshold)
        for i, j in zip(a, b):
            if i != j:
                n[ids[i]] += 1
                linked.append((ids[i], ids[j]))
    comp = components(len(rows), linked)
    least = {}
    for i, r in enumerate(rows):
        least[comp[i]] = min(least.get(comp[i], 1 << 62), r[0] if r[0] is not None else 1 << 62)
    return sorted(((r[0], n[i], least[comp[i]] if r[0] is not None else None) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [2048, 7])
def test_odd_vectors_and_a_dense_group_in_one_or_many_blocks(spark, block):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((6, 64))
    f = lambda x: [float(y) for y in x]
    rows = [(0, f(v[0]), 1), (1, f(v[0] * 2), 1), (2, f(v[0]), 1), (3, f(v[0]), 2), (4, None, 1), (5, [0.0] * 64, 1), (6, [float("nan")] * 64, 1),
            (7, [None, *f(v[0])[1:]], 1), (8, [], 1), (9, f(v[0]), None), (10, [1.0, 2.0], 1), (11, [2.0, 4.0], 1), (12, f(v[1]), 1),
            (None, f(v[0]), 1), (13, f(-v[0]), 1), (14, [float("inf")] * 64, 1), (15, f(v[0] * 1e150), 1)]
    rows += [(20 + i, f(v[2] + rng.standard_normal(64) * 0.12), 3) for i in range(80)] + [(200 + i, f(v[3]), 3) for i in range(50)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, rep string, names string").repartition(3)
    assert sorted(map(tuple, near_duplicates(df, block=block).collect()), key=str) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine lies just above the threshold are the hardest."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cos = 0.98 + 0.0005 * rng.random()
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (cos * a + np.sqrt(1 - cos * cos) * b).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in near_duplicates(df).collect())
    assert 0.99 * 1200 <= found <= 1200


def test_settings_follow_the_size():
    for n in (1, 1000, 10**9):
        cells, tables, enough = settings(0.98, 0.9995, n)
        assert cells >= 4 and tables >= 1 and 10 < enough < 24


def test_query_over_all_vectors(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{base}/embeddings.parquet").collect()]
    got = QUERIES["op3_embedding_near_dedup"](spark, base).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
