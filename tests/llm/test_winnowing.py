import hashlib

import xxhash
from pyspark.sql import functions as F

from feedline.llm.queries import QUERIES
from feedline.llm.winnowing import compare_edited, entries, next_documents, with_fingerprint
from feedline.llm.scratch import Scratch

from .common import WORD, docs, odd_rows, words


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chosen(text, k=5, w=8):
    ws = WORD.findall(text or "")
    if not ws:
        return []
    grams = []
    for i in range(max(1, len(ws) - k + 1)):
        h = 42
        for x in ws[i:i + k]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        grams.append(signed(h) >> 24)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        win = grams[i:i + w]
        least = min(win)
        at = i + max(j for j, x in enumerate(win) if x == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


def brute(rows):
    rows = [(d, t or "") for d, t in rows]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    follow = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for d, t in rows:
        n, nxt = len(t), follow[d, t][1]
        edited = t[:n - n // 3] + nxt[:n // 3]
        f, e, x = ({h for h, _ in chosen(s)} for s in (t, edited, nxt))
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), alike(f, e), alike(f, x)))
    return sorted(out, key=str)


def test_chosen_grams_and_positions(spark):
    rows = [*odd_rows(), (20, "a b " * 40), (21, "a b c d e")]
    got = with_fingerprint(docs(spark, rows).select("text", F.lit(1).alias("size")), "text", "c").select("text", entries(F.col("c")).alias("e")).collect()
    for r in got:
        assert [(x.hash, x.position) for x in r.e] == chosen(r.text)


def test_shared_words_leave_a_shared_hash():
    import random

    rng = random.Random(9)
    for _ in range(50):
        shared = words(12, rng)
        a, b = (words(rng.randrange(30), rng) + shared + words(rng.randrange(30), rng) for _ in range(2))
        assert {h for h, _ in chosen(" ".join(a))} & {h for h, _ in chosen(" ".join(b))}


def test_edited_texts_of_odd_rows(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    got = compare_edited(df).collect()
    assert sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.near_edited, r.near_next) for r in got), key=str) == brute(rows)
    assert compare_edited(df.limit(0)).count() == 0
    alone = compare_edited(docs(spark, [(1, "a b c d e f")])).collect()
    assert [(r.edited, r.near_next) for r in alone] == [("a b c d a b", 1.0)]


def test_successors_across_ranges(spark):
    ids = spark.createDataFrame([(i * 3, t, 1) for i in range(200) for t in (0, 1)], "did long, tie long, n_chars long")
    got = {(r.did, r.tie): (r.next_did, r.next_tie) for r in next_documents(ids, Scratch(spark, "t"), 17).collect()}
    order = sorted(got, reverse=True)
    assert len(order) == 400 and all(got[x] == order[(i + 1) % 400] for i, x in enumerate(order))


def test_query_over_all_documents(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    got = QUERIES["op8_winnowing"](spark, base)
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
    got = got.collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == brute(rows)
    texts = dict(rows)
    names = {}
    for r in got:
        assert names.setdefault(tuple(chosen(texts[r.doc_id])), r.fingerprint) == r.fingerprint
    assert len(set(names.values())) == len(names)
