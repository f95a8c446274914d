import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from feedline.llm.simhash import fingerprints, keep_one_each, near_groups, simhash, trie_links
from feedline.llm.components import connected_components
from feedline.llm.scratch import Scratch

from .common import WORD, components, docs, odd_rows, words


def brute(text, k=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_of_a_text():
    for t in [None, "", "a", "A b", "a B c", "a b c d É", "the the the the", "x " * 40]:
        assert simhash(t) == brute(t)


def test_groups_of_odd_rows(spark):
    rows = odd_rows()[:8] + odd_rows()[8:]
    got = near_groups(docs(spark, rows)).collect()
    fps = [brute(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    comp = components(len(rows), linked)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(least.get(comp[i], d), d)
    want = sorted(((d, signed(fps[i]), least.get(comp[i])) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_one_of_each_group_stays(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    kept = keep_one_each(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({r.component_id for r in near_groups(df).collect()})
    assert keep_one_each(df.limit(0)).count() == 0


def test_trie_join_finds_all_links_in_plain_and_cut_tries(spark):
    rng = np.random.default_rng(0)
    f = {int(x) for x in rng.integers(0, 1 << 63, 150)}
    for x in list(f)[:60]:
        for _ in range(5):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            f.add(x)
    f = sorted(f)
    a = np.array(f, np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None]) <= 3)
    want = components(len(f), list(zip(i.tolist(), j.tolist())))
    df = spark.createDataFrame([(signed(x),) for x in f], "fp long")
    for limit in (20_000, 2):
        got = {r.node: r.root for r in connected_components(trie_links(df, 3, limit), Scratch(spark, "t")).collect()}
        group = [got.get(signed(x), signed(x)) for x in f]
        assert len(set(zip(group, want))) == len(set(group)) == len(set(want))


def test_fingerprints_of_an_empty_table(spark):
    assert fingerprints(docs(spark, [(1, "a")]).filter(F.lit(False))).count() == 0


def test_groups_without_ids_and_texts_that_share_an_id_all_keep_one_row(spark):
    a, b, c, d, e = (" ".join(words(60, random.Random(i))) for i in range(5))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (5, d), (6, c), (7, e), (None, e)]
    got = sorted(((r.doc_id, r.text) for r in keep_one_each(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (5, d), (7, e)], key=str)
