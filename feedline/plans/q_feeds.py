"""Registered queries for the markup, tabular and card feeds (S5-S11), unions (U1, U2),
per-group windows (W3-W5, F13), URL-first dedup (A2), keyword theta join (J6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..operators.dedup import dedup_first
from ..operators.joins import keyword_semi
from ..operators.predicates import RESPONSE_REASONS, valid_posting
from ..operators.windows import cut_after_first_block, newest, per_site_cap
from ..session import release
from ..sources import card_feeds as cf
from ..sources import fixtures as fx
from ..sources import fs, json_feeds, markup_feeds, payloads
from ..sources import payloads_markup as pm
from ..sources.registry import LocalSearch, union_feeds
from ..sources.tables import table
from ..streaming.flows import checkpoint_path
from .registry import packed, register

CITY = "celaya"


def _p(spark, base):
    return fx.postings(spark, base)


@register("src_rss")
def q_src_rss(spark, base):
    return packed(markup_feeds.read_rss(pm.rss_payloads(_p(spark, base))))


@register("src_html_cards")
def q_src_html_cards(spark, base):
    return packed(markup_feeds.read_result_cards(pm.card_page_payloads(_p(spark, base))))


@register("src_html_list")
def q_src_html_list(spark, base):
    return packed(markup_feeds.read_list_links(pm.list_page_payloads(_p(spark, base))))


def _tab(spark, base):
    rows = pm.tabular_rows(_p(spark, base))
    return cf.read_tabular_passes(spark, rows.filter(F.col("run_no") == 0), rows.filter(F.col("run_no") == 1))


@register("src_tabular")
def q_src_tabular(spark, base):
    """S8 + J8 + P8: both passes of the tabular feed."""
    return _tab(spark, base).withColumn("seq", F.col("seq.pos"))


@register("union_passes")
def q_union_passes(spark, base):
    """Remote and local pass of the same feed, counted per pass."""
    return _tab(spark, base).groupBy("is_remote").agg(F.count(F.lit(1)).alias("n"))


@register("source_map")
def q_source_map(spark, base):
    """Rows per mapped source (unknown sites dropped by the inner join)."""
    return _tab(spark, base).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("per_site_cap")
def q_per_site_cap(spark, base):
    """Newest 50 per source within the last 720 hours of as_of."""
    capped = per_site_cap(_tab(spark, base), 50, 720, fx.AS_OF, site="source")
    return capped.select("source", "url", "posted_at", F.col("rank").cast("bigint").alias("rank"))


@register("src_card_text")
def q_src_card_text(spark, base):
    cards = pm.card_rows(_p(spark, base), "bumeran", cf.CARD_TEXT_BASE)
    return packed(cf.read_card_text(cards, city=CITY))


@register("src_card_fields")
def q_src_card_fields(spark, base):
    cards = pm.card_rows(_p(spark, base), "computrabajo", cf.CARD_FIELDS_BASE)
    return packed(cf.read_card_fields(cards, city=CITY))


@register("src_card_links")
def q_src_card_links(spark, base):
    cards = pm.card_rows(_p(spark, base), "occ", cf.CARD_LINKS_BASE)
    return packed(cf.read_card_links(cards, city=CITY))


@register("first_blocked")
def q_first_blocked(spark, base):
    """Card rows left after each feed's first blocked page."""
    p = _p(spark, base)
    cards = pm.card_rows(p, "bumeran", cf.CARD_TEXT_BASE).unionByName(
        pm.card_rows(p.filter(F.col("seq") % 2 == 0), "occ", cf.CARD_LINKS_BASE))
    return cut_after_first_block(cards).select("feed", "step", "pos")


@register("latest_thread")
def q_latest_thread(spark, base):
    hits = pm.thread_hits(table(spark, base, "orders"))
    return newest(hits, "created_at", "object_id", ["object_id", "title", "created_at"])


@register("dedup_url_first")
def q_dedup_url_first(spark, base):
    p = _p(spark, base).filter(valid_posting()).select("url", "seq", "title")
    return dedup_first(p, "url")


def land_feeds(spark, p, root: str) -> None:
    """All eleven feeds' responses under ``root``, a file each; the files of a feed are named in the order of its pages.

    What one feed is built by leaves the disks before the next.
    """
    texts = {
        "remoteok": payloads.json_array_payloads(p), "remotive": payloads.json_envelope_payloads(p),
        "himalayas": payloads.json_salaried_payloads(p), "hackernews": payloads.thread_payloads(p),
        "wwr": pm.rss_payloads(p), "getonboard": pm.card_page_payloads(p), "cybersecjobs": pm.list_page_payloads(p),
    }
    for name, pages in texts.items():
        thread = F.get_json_object("payload", "$.id") if name == "hackernews" else F.lit("0")
        payloads.land_pages(pages.withColumn("thread", thread), f"{root}/{name}", "payload_id", "thread")
        release(spark, 0)
    for name, site in (("bumeran", cf.CARD_TEXT_BASE), ("computrabajo", cf.CARD_FIELDS_BASE), ("occ", cf.CARD_LINKS_BASE)):
        pm.card_rows(p, name, site).write.option("compression", fs.CODEC).parquet(f"{root}/{name}")
    rows = pm.tabular_rows(p)
    rows.filter(F.col("run_no") == 0).write.option("compression", fs.CODEC).parquet(f"{root}/jobspy/remote")
    rows.filter(F.col("run_no") == 1).write.option("compression", fs.CODEC).parquet(f"{root}/jobspy/local")


#: All feeds, in the default order.
ALL_FEEDS = ("jobspy", "remoteok", "remotive", "wwr", "cybersecjobs", "computrabajo", "bumeran", "himalayas", "hackernews", "occ", "getonboard")


@register("union_feeds")
def q_union_feeds(spark, base):
    """U1 over all landed feeds: feed order, then the files in natural order, then the place in the file."""
    root = checkpoint_path(spark, "union")
    land_feeds(spark, fs.kept(_p(spark, base), f"{root}/postings"), f"{root}/landing")
    fs.delete(spark, f"{root}/postings")
    rows, failed = union_feeds(spark, f"{root}/landing", ALL_FEEDS, LocalSearch(CITY, True))
    fs.delete(spark, root)  # what the feeds gave is kept
    if failed:
        raise RuntimeError(str(failed))
    rows = rows.select("seq.feed", "seq.payload", "seq.pos", "source", fingerprint().alias("fingerprint"))
    # files are few beside rows: their numbers come from the distinct names
    files = rows.select("feed", "payload").distinct().withColumn(
        "file", F.dense_rank().over(Window.partitionBy("feed").orderBy("payload")).cast("bigint"))
    return rows.join(files, ["feed", "payload"]).select("feed", "file", "pos", "source", "fingerprint")


def spoiled(pages, shape: str):
    """Payloads of which some are cut, empty or of another shape, by their number."""
    k = F.col("payload_id") % 7
    return pages.withColumn("payload", F.when(k == 1, F.lit("{not json <rss")).when(k == 2, F.lit(" \n")).when(k == 3, F.lit(shape)).otherwise(F.col("payload")))


@register("response_rejects")
def q_response_rejects(spark, base):
    """responses that gave nothing, by feed and reason, from the same scan as the items."""
    p = _p(spark, base).checkpoint()
    feeds = {"remoteok": (json_feeds.read_json_array, payloads.json_array_payloads(p), '{"a": 1}'),
             "remotive": (json_feeds.read_json_envelope, payloads.json_envelope_payloads(p), '{"jobs": "none"}'),
             "himalayas": (json_feeds.read_json_salaried, payloads.json_salaried_payloads(p), "[1, 2]"),
             "wwr": (markup_feeds.read_rss, pm.rss_payloads(p), "<html><body>down</body></html>")}
    rows = [read(spoiled(pages, shape), with_rejects=True).select(F.lit(name).alias("feed"), "reason") for name, (read, pages, shape) in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).filter(F.col("reason").isin(*RESPONSE_REASONS)).groupBy("feed", "reason").agg(F.count(F.lit(1)).alias("n"))


# A long list of terms is one scan of each text as well.
THETA_TERMS = ("widget", "schkeit", *[f"zz-term-{i:03d}" for i in range(60)])


@register("keyword_theta")
def q_keyword_theta(spark, base):
    return keyword_semi(_p(spark, base), THETA_TERMS).select("seq")
