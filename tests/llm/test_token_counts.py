import random
import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedline.llm.queries import QUERIES
from feedline.llm.scratch import Scratch
from feedline.llm.token_counts import TokenTotals, count_tokens

from .common import WORD, docs, odd_rows

CHANGE = "doc_id long, version string, op string, source string, lang string, tokens long, seq long, old string"


def totals(t):
    return {tuple(r)[:3]: tuple(r)[3:] for r in t.totals().collect()}


def fresh(spark):
    return TokenTotals(spark, f"{Scratch(spark, 'totals').root}/{uuid.uuid4().hex}")


def changes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CHANGE)


def apply(state, rows):
    last = {}
    for d, v, op, s, g, n, seq in rows:
        key = (seq, n or 0, s is not None, s or "", g is not None, g or "", op)
        if (d, v) not in last or key > last[d, v][0]:
            last[d, v] = key, (op, s, g, n or 0)
    for k, (_, (op, s, g, n)) in last.items():
        if op == "delete":
            state.pop(k, None)
        elif op == "insert":
            state[k] = s, g, n
        elif k in state:
            state[k] = s if s is not None else state[k][0], g if g is not None else state[k][1], n
    out = {}
    for (_, v), (s, g, n) in state.items():
        a = out.get((s, g, v), (0, 0))
        out[s, g, v] = a[0] + 1, a[1] + n
    return out


def test_random_batches_replays_and_compaction(spark):
    rng = random.Random(4)
    t, state = fresh(spark), {}
    for batch in range(1, 7):
        rows = [(rng.choice([None, *range(30)]), rng.choice(["v1", "v2", None]), rng.choice(["insert", "insert", "revise", "delete"]),
                 rng.choice([None, "a", "b"]), rng.choice([None, "en"]), rng.choice([None, *range(50)]), rng.randrange(1000)) for _ in range(40)]
        assert t.commit(batch, changes(spark, rows))
        want = apply(state, rows)
        assert totals(t) == want
        assert not t.commit(batch, changes(spark, rows)) and totals(t) == want
        if batch == 3:
            t.compact()
            assert totals(t) == want
    assert {(r.doc_id, r.version): (r.source, r.lang, r.tokens) for r in t.state().collect()} == state


def test_a_batch_that_broke_off_is_written_anew(spark):
    t = fresh(spark)
    t.commit(1, changes(spark, [(1, "v", "insert", "a", "en", 10, 0)]))
    mark = t._mark

    def broken(kind, batch):
        raise OSError("lost")

    t._mark = broken
    with pytest.raises(OSError):
        t.commit(2, changes(spark, [(1, "v", "revise", None, None, 99, 0), (2, "v", "insert", "a", "en", 1, 0)]))
    assert totals(t) == {("a", "en", "v"): (1, 10)}
    t._mark = mark
    assert t.commit(2, changes(spark, [(1, "v", "revise", None, None, 7, 0)]))
    assert totals(t) == {("a", "en", "v"): (1, 7)}
    with pytest.raises(ValueError):
        t.commit(0, changes(spark, []))


def test_empty_batches(spark):
    t = fresh(spark)
    assert totals(t) == {} and t.commit(1, changes(spark, [])) and totals(t) == {}
    t.compact()
    assert t.commit(2, changes(spark, [(5, "v", "delete", None, None, None, 0), (6, "v", "revise", "a", "en", 3, 0)])) and totals(t) == {}


def test_counts_of_odd_rows(spark):
    rows = odd_rows()
    got = count_tokens(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "b", keep=("doc_id",)).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(((r.doc_id, r.tokens) for r in got), key=str) == sorted(((d, len(lib.encode(t or "").ids)) for d, t in rows), key=str)


def test_query_totals(spark):
    base = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    seen, want = set(), {}
    for r in sorted(spark.read.parquet(f"{base}/documents.parquet").collect(), key=lambda r: r.doc_id):
        if r.text in seen:
            continue
        seen.add(r.text)
        for v, n in (("byte_bpe_50k", len(lib.encode(r.text, add_special_tokens=False).ids) + 1), ("words", len(WORD.findall(r.text)))):
            a = want.get((r.source, r.lang, v), (0, 0))
            want[r.source, r.lang, v] = a[0] + 1, a[1] + n
    assert {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op4_token_counts"](spark, base).collect()} == want
