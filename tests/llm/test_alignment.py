"""Cross-tokenizer alignment against a plain loop over whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from feedline.llm import alignment
from feedline.llm.queries import QUERIES

from .common import docs, odd_rows

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and the digest of each text, tokenised whole."""
    pair = alignment.Pair.load(*PATHS)
    each = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        if b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
            each.append(([], [], []))
            continue
        ends = []
        for ids, of in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, out = 0, {}
            for n, i in enumerate(ids):
                at += len(of[i])
                out[at] = n
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            p, q = ends[0][c] + 1, ends[1][c] + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        each.append((a, b, groups))
    count = Counter((x[-1], y[-1]) for _, _, g in each for x, y in g)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, g in each:
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append((len(a), len(b), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = ["<|endoftext|> <s> </s> <unk> [INST]", "a▁b", "café  naïve  　x", "tabs\t\ttwo  spaces\n\n  lines \r\n", " ", "  ", " lead", "trail ",
       "trail  ", "ﬁ ½ \U0001F600\U0001F600 你好 да", "\x00\x01 z", "don't we'll 123 1234 1.5e-3", "x" * 5000, "ab " * 3000, "é " * 50, "  a\u0085 b"]


def run(df):
    groups = alignment.token_groups(df, *PATHS)
    counts = alignment.pair_counts(groups, *PATHS)
    return alignment.score_links(groups, counts, *PATHS), counts


def test_equals_brute_force(spark):
    given = [(n, t) for n, t in enumerate(ODD)] + odd_rows()
    got, _ = run(docs(spark, given))
    got = sorted(((r.row.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
                  for r in got.collect()), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(given, brute([t for _, t in given]))), key=str)
    assert got == want


def test_memory_of_segments_may_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    lex = alignment.Lexicon(alignment.Pair.load(*PATHS))
    import numpy as np
    import pyarrow as pa

    for text in ("one two three four five", "six one seven", "two two eight"):
        buf = np.frombuffer(text.encode(), np.uint8)
        got = alignment._align_slice(lex, pa.array([0]), buf, np.array([0, len(buf)]), True)
        assert got.column("n_a").to_pylist() == [brute([text])[0][0]]


def test_plain_and_irregular_pairs_are_apart_and_bounded(spark):
    pair = alignment.Pair.load(*PATHS)
    same = pair.same()
    _, counts = run(docs(spark, odd_rows()))
    rows = counts.collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) <= alignment.most_pairs(pair) < 1_000_000
    for r in rows:
        x, y = pair.a_bytes[r.a], pair.b_bytes[r.b]
        assert x.endswith(y) or y.endswith(x)
        assert (x == y) == (same[r.a] == r.b)
    best = {(r.b, r.a) for r in alignment.best_matches(counts).collect()}
    assert {b for b, _ in best} == {r.b for r in rows}


def test_empty_table_and_clashing_columns(spark):
    df = docs(spark, odd_rows())
    names = df.columns
    assert {"row", "n_a", "fast", "slow", "groups"} <= set(names)
    got = alignment.token_groups(df, *PATHS, keep=tuple(names))
    assert got.select("row.*").columns == names
    assert got.filter("row.fast != 'x'").count() == 0
    assert run(docs(spark, odd_rows()).filter("false"))[0].count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    base = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows]))}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_cross_tokenizer_alignment"](spark, base).collect()}
    assert got == want
