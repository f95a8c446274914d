"""Registered queries for the streaming twins.

Each query lands the derived rows as files under the session's checkpoint
folder, drives the stream to completion with ``availableNow`` (one landing =
one run), and returns what the stream wrote, read back as a batch
DataFrame -- so the driver can compare it with the batch twin's SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..params import LeadParams, PostingParams
from ..session import release
from ..sources import card_feeds as cf
from ..sources import crawl, fixtures as fx, fs, json_feeds, payloads
from ..sources import payloads_markup as pm
from ..sources.registry import LocalSearch, stream_readers
from ..streaming import flows
from .registry import packed, register
from .state import Store

COLS = ["seq", "title", "company", "location", "url", "source", "is_remote", "description", "posted_at",
        "min_salary_usd_monthly", "fingerprint"]


def _landed(spark, base, name):
    root = flows.checkpoint_path(spark, name)
    return root, os.path.join(root, "landing")


def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _cannot_read(payloads_df, with_rejects=True):
    """A feed whose payloads break its reader while they are read."""
    rows = json_feeds.read_json_array(payloads_df, with_rejects)
    return rows.withColumn("title", F.raise_error(F.lit("unreadable response")).cast("string"))


def card_payloads(cards):
    """Rendered pages as landed responses: the cards of a page as one JSON list."""
    fields = ["step", "pos", "href", "raw", "title", "company", "text", "is_remote", "blocked"]
    pages = cards.groupBy(F.col("step").alias("payload_id")).agg(F.collect_list(F.struct(*fields)).alias("cards"))  # 50 at most
    return pages.select("payload_id", F.to_json("cards").alias("payload"))


@register("stream_postings")
def q_stream_postings(spark, base):
    """T1 + T2: two landings of nine feeds and a broken one -> two availableNow runs -> saved table."""
    root, land = _landed(spark, base, "postings")
    p = fs.kept(fx.postings(spark, base), os.path.join(root, "postings"))
    store = Store(spark, os.path.join(root, "state"))
    search = LocalSearch("celaya", True)
    params = PostingParams(keywords=fx.FIXTURE_KEYWORDS, require_remote=True, max_years=None, max_age_days=fx.FIXTURE_MAX_AGE_DAYS,
                           blacklist=None, allowed_languages=None, as_of=fx.AS_OF, search=search)
    known = stream_readers(spark, search)
    names = ("remoteok", "remotive", "wwr", "cybersecjobs", "computrabajo", "bumeran", "himalayas", "occ", "getonboard")
    readers = {**{n: known[n] for n in names}, "hackernews": _cannot_read}
    send = flows.digest_sink(os.path.join(root, "digests"), params.digest_size)
    for run in (0, 1):
        q = p.filter(F.col("run_no") == run)
        feeds = {"remoteok": payloads.json_array_payloads(q), "remotive": payloads.json_envelope_payloads(q), "wwr": pm.rss_payloads(q),
                 "cybersecjobs": pm.list_page_payloads(q), "himalayas": payloads.json_salaried_payloads(q), "getonboard": pm.card_page_payloads(q),
                 "bumeran": card_payloads(pm.card_rows(q, "bumeran", cf.CARD_TEXT_BASE)),
                 "computrabajo": card_payloads(pm.card_rows(q, "computrabajo", cf.CARD_FIELDS_BASE)),
                 "occ": card_payloads(pm.card_rows(q, "occ", cf.CARD_LINKS_BASE)), "hackernews": payloads.json_array_payloads(q)}
        for n in list(feeds):
            pages = feeds.pop(n).select(F.lit(n).alias("feed"), F.concat(F.lit(f"20260707-{run}-"), F.col("payload_id").cast("string")).alias("payload_id"), "payload")
            pages.write.mode("append").option("compression", fs.CODEC).partitionBy("feed").parquet(land)
            del pages
            release(spark, 0)
        _run(flows.postings_stream(spark, land, store, params, send, os.path.join(root, "checkpoint"), readers, packed=True))
        fs.delete(spark, land)  # its run has committed
    fs.delete(spark, os.path.join(root, "postings"))
    return store.rows().select("fingerprint", "title", "source", "run_id")


@register("stream_dedup_bounded")
def q_stream_dedup_bounded(spark, base):
    """Watermark-bounded dedup over two landings, the second with late rows: how often each key came out."""
    root, land = _landed(spark, base, "bounded")
    p = fx.postings(spark, base).select(*COLS, "run_no").checkpoint()
    sink, ckpt, schema = os.path.join(root, "out"), os.path.join(root, "checkpoint"), p.drop("run_no").schema
    for run in (0, 1):
        p.filter(F.col("run_no") == run).drop("run_no").write.mode("append").parquet(land)
        _run(flows.bounded_dedup_stream(spark, land, schema, sink, ckpt, "100 days"))
    return spark.read.parquet(sink).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@register("late_postings")
def q_late_postings(spark, base):
    """T4: recency per micro-batch over two landings; undated postings pass."""
    root, land = _landed(spark, base, "late")
    p = fx.postings(spark, base).select(*COLS, "run_no")
    sink = os.path.join(root, "out")
    ckpt = os.path.join(root, "checkpoint")
    schema = p.drop("run_no").schema
    for run in (0, 1):
        p.filter(F.col("run_no") == run).drop("run_no").write.mode("append").parquet(land)
        _run(flows.late_postings_stream(spark, land, schema, sink, ckpt, fx.FIXTURE_MAX_AGE_DAYS, fx.AS_OF))
    return spark.read.parquet(sink).select("seq")


@register("stream_leads")
def q_stream_leads(spark, base):
    """T5: landed geo payloads -> leads flow -> leads store (one run)."""
    root, land = _landed(spark, base, "leads")
    pl = payloads.geo_payloads(fx.geo_elements(spark, base))
    pl.write.parquet(land)
    store = Store(spark, os.path.join(root, "state"), "leads", leads=True)
    from ..operators.digest import LEAD_HEADER, lead_line
    send = flows.digest_sink(os.path.join(root, "digests"), 30, LEAD_HEADER, lead_line())
    rules = crawl.robots_rules(crawl.robots_bodies(fx.robots_rules(spark, base)))
    params = LeadParams(fx.CENTRE[0], fx.CENTRE[1], fx.RADIUS_KM, max_per_run=None, digest_size=30)
    _run(flows.leads_stream(spark, land, pl.schema, fx.crawl_pages(spark, base), rules, params, store, send,
                            os.path.join(root, "checkpoint")))
    return packed(store.rows()).select("seq", "name", "website", "latitude", "longitude", "email",
                                       "email_is_hr_context", "status", "fingerprint")
