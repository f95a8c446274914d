import random
import zlib

import numpy as np
import pyarrow as pa

from feedline.llm.batches import text_bytes
from feedline.llm.quality import Settings, features, fit, score, train
from feedline.llm.queries import QUERIES

from .common import docs, odd_rows, words

SMALL = Settings(steps=150, buckets=1 << 12)


def test_features_do_not_cross_texts():
    texts = ["", "a b a b", "xyz", None, "q", "aa  aa\naa", ""]
    buf, offs = text_bytes(pa.array(texts))
    together = list(features(buf, offs, 1 << 12))
    for i, t in enumerate(texts):
        b, o = text_bytes(pa.array([t]))
        for (idx, at), (alone, _) in zip(together, features(b, o, 1 << 12)):
            assert idx[at[i]:at[i + 1]].tolist() == alone.tolist()


def test_held_out_rows_are_told_apart(spark):
    base = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    rows = QUERIES["op5_quality_classifier"](spark, base).collect()
    assert len(rows) == spark.read.parquet(f"{base}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) >= 0.97


def test_odd_rows_labels_and_empty_tables(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, " ".join(words(60, rng)) if i % 2 else "!!! ".join(words(60, rng))) for i in range(40)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)] + [(2, 1), (3, None), (None, 0), (4, 7), (100, 0)], "doc_id long, quality int")
    model = fit(df, labels, SMALL)
    got = {}
    for r in score(df, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert sum(map(len, got.values())) == len(rows) and all(0 <= s <= 1 for v in got.values() for s in v)
    assert all((got[100 + i][0] >= 0.5) == (i % 2 == 1) for i in range(40))
    assert got[1] == got[2] and len(set(got[5])) == 1
    keep = score(df, model, keep=tuple(df.columns), out="__score")
    assert keep.columns == [*df.columns, "__score"] and keep.count() == len(rows)
    assert fit(df, labels, SMALL).weight.tolist() == model.weight.tolist()
    none = fit(df, labels.limit(0), SMALL)
    assert {r.score for r in score(df, none).collect()} == {0.5}
    assert min(r.score for r in score(df, fit(df, labels.filter("quality = 1"), SMALL)).collect()) > 0.99
    assert score(df.limit(0), model).count() == 0


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(0)
    idx = np.concatenate([rng.integers(0, 50, 20) + 50 * (i % 2) for i in range(60)])
    offs, label = np.arange(61) * 20, np.arange(60) % 2
    m = train(idx, np.ones(len(idx), np.float32), offs, label, Settings(buckets=128, steps=100, rate=5))
    z = m.bias + m.weight[idx].reshape(60, 20).mean(axis=1)
    assert ((z > 0) == label).all()


def test_scores_equal_a_plain_loop_over_features():
    """``Model.score`` against each text's words, pairs and grams looked up one by one."""
    import math

    from feedline.llm.batches import M1, M2, mix64, prefix_sums, span_hashes
    from feedline.llm.quality import Model

    from .common import WORD

    buckets, mask = 1 << 12, (1 << 64) - 1
    shift = 64 - 12
    rng = np.random.default_rng(4)
    model = Model(rng.normal(size=buckets).astype(np.float32), -0.3)

    def name(word):
        buf = np.frombuffer(word.encode(), np.uint8)
        return int(span_hashes(prefix_sums(buf), np.array([0]), np.array([len(buf)]))[0])

    def plain(text):
        raw = (text or "").encode()
        h = [name(w) for w in WORD.findall(text or "")]
        found = [x >> shift for x in h]
        found += [int(mix64(np.array([((b - a) * int(M1) + 1) & mask], np.uint64))[0]) >> shift for a, b in zip(h, h[1:])]
        found += [((int.from_bytes(raw[i:i + 4], "little") + int(M1)) * int(M2) & mask) >> shift for i in range(len(raw) - 3)]
        z = model.bias + (sum(float(model.weight[f]) for f in found) / len(found) if found else 0.0)
        return 1 / (1 + math.exp(-z))

    texts = ["", None, "a", "a b", "abc abc abc", "Ünï cödé  wörds\n\there", " lead and trail ", "x" * 300, *(" ".join(words(40, random.Random(i))) for i in range(5))]
    buf, offs = text_bytes(pa.array(texts))
    assert np.allclose(model.score(buf, offs), [plain(t) for t in texts], rtol=1e-9)
