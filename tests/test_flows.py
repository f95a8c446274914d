"""End-to-end checks on the smallest driver tables: language model quality,
streaming equals batch, and a representative set of queries against their
DuckDB twins (the full set runs in scripts/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from feedline.plans import catalog
from feedline.plans.oracle_sql import ORACLE
from feedline.sources.tables import TABLES

from .conftest import SF_SMALL

QUERIES, ORACLES = catalog.QUERIES, ORACLE
ORACLE_SUBSET = ["new_postings", "posting_filter", "filter_funnel", "required_years", "dedup_batch_last",
                 "digest_text", "src_json_salaried", "src_thread_comments", "src_rss", "src_html_cards",
                 "src_card_text", "best_email", "new_leads", "union_feeds", "per_site_cap", "robots_anti", "radius_join",
                 "retry_pending", "mark_notified", "digest_log", "stream_postings", "stream_dedup_bounded", "discovery_cap",
                 "detect_language", "unknown_feeds"]


def _sorted(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", ORACLE_SUBSET)
def test_query_matches_duckdb_twin(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _sorted(tuple(r[c] for c in cols) for r in df.collect())
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = _sorted(tuple(r[i] for i in idx) for r in cur.fetchall())
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "fingerprint" in df.columns and df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_language_model_separates_languages(spark):
    acc = {r["lang"]: (r["n"], r["n_correct"]) for r in QUERIES["language_accuracy"](spark, SF_SMALL).collect()}
    n = sum(v[0] for v in acc.values())
    correct = sum(v[1] for v in acc.values())
    assert n > 0 and correct / n > 0.9


def test_stream_leads_equals_batch_twin(spark):
    q = QUERIES
    cols = ["seq", "name", "website", "latitude", "longitude", "email", "email_is_hr_context", "status",
            "fingerprint"]
    assert _sorted(q["stream_leads"](spark, SF_SMALL).select(*cols).collect()) == \
        _sorted(q["new_leads"](spark, SF_SMALL).select(*cols).collect())


def test_large_profile_takes_the_join_and_agrees(spark):
    import dataclasses

    from pyspark.sql import functions as F

    from feedline.operators.language import detect, fit_profile
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    profile = fit_profile(docs)
    small = detect(docs, profile, F.col("text"), "doc_id").select("doc_id", "detected_lang", F.round("detected_prob", 6))
    large = detect(docs, dataclasses.replace(profile, limit=0), F.col("text"), "doc_id").select("doc_id", "detected_lang", F.round("detected_prob", 6))
    assert _sorted(small.collect()) == _sorted(large.collect())
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # scored inside the row


def test_leads_run_in_batch_with_a_cap(spark, tmp_dir):
    from feedline.params import LeadParams
    from feedline.plans.leads_flow import run_leads
    from feedline.plans.state import Store
    from feedline.sources import crawl, fixtures as fx, payloads
    pages = fx.crawl_pages(spark, SF_SMALL)
    rules = crawl.robots_rules(crawl.robots_bodies(fx.robots_rules(spark, SF_SMALL)))
    landed = payloads.geo_payloads(fx.geo_elements(spark, SF_SMALL))
    store, params = Store(spark, tmp_dir + "/leads", "leads", leads=True), LeadParams(*fx.CENTRE, 200.0, max_per_run=3)
    rep = run_leads(spark, landed, pages, rules, store, 0, params, lambda *_: True)
    assert rep.inserted == 3 and run_leads(spark, landed, pages, rules, store, 1, params, lambda *_: True).inserted == 0


def test_one_unreadable_feed_leaves_the_others_and_rejects_are_kept(spark, tmp_dir):
    import json
    import os

    from feedline.sources.registry import union_feeds
    for feed, text in (("remotive", json.dumps({"jobs": [{"title": "Ops", "company_name": "B", "url": "https://r/1"},
                                                         {"title": "Bad", "company_name": "B", "url": "ftp://r/1"}, {"title": None}]})),):
        os.makedirs(os.path.join(tmp_dir, feed))
        with open(os.path.join(tmp_dir, feed, "page-1.json"), "w") as f:
            f.write(text)
    os.makedirs(os.path.join(tmp_dir, "occ"))
    with open(os.path.join(tmp_dir, "occ", "part-0.parquet"), "wb") as f:
        f.write(b"PAR1 broken")
    rows, failed = union_feeds(spark, tmp_dir, ["occ", "remotive", "wwr"], quarantine=os.path.join(tmp_dir, "quarantine"))
    assert [r["title"] for r in rows.collect()] == ["Ops"] and set(failed) == {"occ", "wwr"}
    bad = spark.read.parquet(os.path.join(tmp_dir, "quarantine"))
    assert sorted((r["feed"], r["reason"]) for r in bad.collect()) == [("remotive", "bad_url"), ("remotive", "malformed")]


def test_a_landing_leaves_once_its_run_has_committed(spark, tmp_dir, monkeypatch):
    import os

    from feedline.plans import q_streaming
    from feedline.streaming import flows
    seen = []
    run, path = q_streaming._run, f"{tmp_dir}/postings"
    monkeypatch.setattr(flows, "checkpoint_path", lambda spark, name: path)
    monkeypatch.setattr(q_streaming, "_run", lambda q: (seen.append(sorted(os.listdir(path))), run(q)))
    assert q_streaming.q_stream_postings(spark, SF_SMALL).count() > 0
    assert len(seen) == 2 and "landing" in seen[0] and sorted(os.listdir(path)) == ["checkpoint", "checkpoint-feeds", "digests", "state"]
    assert not [f for _, _, fs in os.walk(f"{path}/checkpoint-feeds") for f in fs]
