import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedline.llm.queries import QUERIES
from feedline.llm.suffixes import GRAM, LAST, LENGTH, compare_suffixes, judge_runs, meet_holders, multikey_groups, repeated, runs_in

from .common import docs, odd_rows


def brute(rows):
    rows = [(LAST if d is None else d, (t or "").encode(), d) for d, t in rows]
    first = {}
    for d, b, _ in sorted(rows, key=lambda r: r[0]):
        for i in range(len(b) - LENGTH + 1):
            first.setdefault(b[i:i + LENGTH], d)
    out = []
    for d, b, own in rows:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - LENGTH + 1):
            if first[b[i:i + LENGTH]] < d:
                gone[i] += 1
                gone[i + LENGTH] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((own, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r[0], r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=str)


def text(n, rng):
    return "".join(rng.choice("abcdefgh é ") for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_edges_repetition_and_odd_rows(spark, seed):
    rng = random.Random(seed)
    p = [text(rng.randint(40, 120), rng) for _ in range(6)]
    rows = [(i, text(rng.randint(0, 150), rng) + rng.choice(p) + text(rng.randint(0, 150), rng) + rng.choice(p)[:rng.randint(30, 120)]) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "x " * 3000), (203, "x " * 200 + "y" + "x" * 500), (None, rows[3][1]), (204, rows[4][1]), (204, rows[4][1]),
             (205, "a" * 49), (206, "a" * 50), (207, "a" * 51), (208, rows[5][1] * 2)]
    rows += [(300 + i, text(5, rng) + p[0] * 3 + text(5, rng)) for i in range(60)]  # one anchor over many partitions
    rows += [(d + 1000 if d else d, t) for d, t in odd_rows() if len(t or "") < 20_000]
    assert digest(repeated(docs(spark, rows, 5))) == brute(rows)


def test_a_text_longer_than_a_piece(spark):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_200_000))
    rows = [(1, body[1_048_500:1_048_700]), (2, body), (3, body[300:] + "z")]
    assert digest(repeated(docs(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert repeated(docs(spark, [(1, "a")]).filter(F.lit(False))).count() == 0


def test_spans_of_neighbouring_texts_stay_apart(spark):
    rows = [(1, "q" * 30 + "abcdefghij" * 5), (2, "abcdefghij" * 5), (3, "abcdefghij" * 5), (4, "")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in repeated(docs(spark, rows, 1)).collect()}
    assert got == {1: [], 2: [(0, 50)], 3: [(0, 50)], 4: []}


def test_multikey_groups_are_equal_strings():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[1000:1100] = buf[2000:2100]
    buf[3000:3200] = 97
    pos = rng.permutation(3900)[:2500]
    g = multikey_groups(buf, pos)
    names = {}
    for p, k in zip(pos, g):
        assert names.setdefault(buf[p:p + LENGTH].tobytes(), k) == k
    assert len(set(names.values())) == len(names)


def test_judged_runs():
    a = np.array([1, 1, 1, 2, 2, 3, 4, 4], np.uint64)
    c = np.array([5, 5, 6, 7, 7, 8, 9, 10], np.uint64)
    did = np.array([9, 4, 5, 1, 1, 2, 3, 3])
    whole, fine = judge_runs(a, c, did)
    assert whole.tolist() == [0] and sorted(fine.tolist()) == [1, 2]


def test_query_over_all_documents(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op9_suffix_array_dedup"](spark, base).collect()), key=str) == brute(rows)


def test_runs_that_share_an_anchor_by_chance_are_not_compared():
    """Bytes on a side of the anchor tell: those of a string that both hold are equal on one side, whatever the anchor's place in it."""
    rng = np.random.default_rng(4)
    own = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    gram, near = own(GRAM), own(34)
    for shared in range(35):  # bytes before the gram that two texts share, of 34 in all
        texts = [np.concatenate([own(60), near[34 - shared:], gram, near[:34 - shared], own(60)]) for _ in range(2)]
        texts += [np.concatenate([own(94), gram, own(94)]) for _ in range(3)]
        texts += [np.concatenate([own(40), gram, own(3), gram, own(60)])] if shared % 5 == 0 else []
        buf, offs = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
        t, s, n, a, c, left, right = runs_in(buf, offs, True)
        _, all_ = judge_runs(a, c, t)
        _, some = judge_runs(a, c, t, left, right)
        strings = {}
        for i in all_:
            for x in range(s[i], s[i] + n[i]):
                strings.setdefault(buf[x:x + LENGTH].tobytes(), {}).setdefault(int(t[i]), []).append(int(i))
        needed = {i for held in strings.values() if len(held) > 1 for rows in held.values() for i in rows}
        assert needed and needed <= set(some.tolist()) <= set(all_.tolist())
        lone = set(np.flatnonzero(np.isin(t, [2, 3, 4])).tolist())
        assert not lone & set(some.tolist()) if shared % 5 else True


def test_a_string_in_two_runs_of_a_document_goes_from_both_over_an_edge():
    """Two ranges of one anchor; the second one's document holds the string of the first in two different runs."""
    rng = np.random.default_rng(5)
    own = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    string = own(LENGTH)
    def one(did, tails):
        rows = [(1, 1, did, i, string + tail) for i, tail in enumerate(tails)]
        return next(compare_suffixes(iter([pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                                      ["l0", "l1", "did", "c", "s"])]), 1)).to_pylist()
    rows = [r for r in one(3, [own(5)]) + one(7, [own(5), own(6)]) if r["b"] is not None]
    got = [b.to_pydict() for b in meet_holders(iter([pa.RecordBatch.from_pylist(rows)]))]
    assert [(b["did"], b["c"], b["mask"]) for b in got] == [([7, 7], [0, 1], [1, 1])]
