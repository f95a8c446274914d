import corpus_pipeline as P
import __spark_entry__ as entry
from feedline.llm.queries import QUERIES
from feedline.llm.scratch import Scratch

from .common import CLASH, docs, odd_rows, with_map

BASE = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    table = spark.read.parquet(f"{BASE}/documents.parquet")
    rows, scratch, counts = table, Scratch(spark, "t"), {}
    for name, stage in P.STAGES:
        before = rows
        rows = scratch.write(stage(spark, rows, BASE), name)
        counts[name] = rows.count()
        if name != "tokens":
            assert rows.columns == table.columns
        if name in ("quality", "simhash"):
            assert rows.exceptAll(before).count() == 0
        if name == "passages":
            assert counts[name] == counts["simhash"]
            for r in rows.join(before.select("doc_id", before.text.alias("was")), "doc_id").collect():
                assert r.n_chars == len(r.text) <= len(r.was)
    assert [n for n, _ in P.STAGES] == ["quality", "simhash", "passages", "mixing", "tokens"]
    assert counts["tokens"] == counts["mixing"] and counts["quality"] < table.count()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    kept = {r.doc_id for r in spark.read.parquet(f"{scratch.root}/quality").collect()}
    assert all(d in kept for d, q in quality.items() if q == 1)
    own = sorted(map(str, P.run(spark, BASE).drop("ids").collect()))
    assert own == sorted(map(str, rows.drop("ids").collect()))


def test_odd_rows_and_empty_tables_pass_through(spark):
    df = docs(spark, [(d, t, "s") for d, t in odd_rows()])
    for rows, some in ((df, True), (df.limit(0), False)):
        scratch = Scratch(spark, "t")
        for name, stage in P.STAGES:
            rows = scratch.write(stage(spark, rows, BASE), name)
        assert (rows.count() > 0) == some


def test_registered_once_for_each_operator():
    names = entry.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names)


def test_other_columns_of_any_name_and_kind_come_through(spark):
    """Each stage but the last gives back the columns it does not change as they were, whatever their names; maps too."""
    rows = with_map(docs(spark, [(d, t, "s") for d, t in odd_rows()])).selectExpr("*", "'x' AS __score")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, BASE)
        assert out.columns == rows.columns, name
        for r in out.collect():
            assert all(r[c] == "x" for c in (*CLASH, "__score")), name
            assert r.tags == {"id": None if r.doc_id is None else str(r.doc_id)} and r.more == [{1: "x"}], name


def test_passages_stage_cuts_what_a_plain_search_cuts(spark):
    """Exact repeats of 60 words in otherwise different texts, against a search for 50 words in a row."""
    import random

    rng = random.Random(21)
    own = lambda n: [f"v{rng.randrange(10 ** 7)}" for _ in range(n)]
    shared = [own(60) for _ in range(4)]
    texts = [[*own(40), *rng.choice(shared), *own(40)] for _ in range(30)]
    seen, want = set(), {}
    for i, w in enumerate(texts):
        cut = set()
        for p in range(len(w) - 49):
            if tuple(w[p:p + 50]) in seen:
                cut.update(range(p, p + 50))
        want[i] = [x for p, x in enumerate(w) if p not in cut]
        seen.update(tuple(w[p:p + 50]) for p in range(len(w) - 49))
    out = P.passages_stage(spark, docs(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]), BASE)
    assert {r.doc_id: r.text.split() for r in out.collect()} == want
