"""Registered queries giving single operators their own key (P10, P13, P18, P19, P21, P22,
P26, P28, F9, F11, F12, U3, T2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import experience, text
from ..functions.html import html_to_text
from ..operators.predicates import known_source, remote_marker_filter, required_fields
from ..sources import card_feeds as cf
from ..sources import fixtures as fx
from ..sources import payloads_markup as pm
from ..sources.tables import spread, table
from ..functions.text import csv_list
from ..schema import KNOWN_FEEDS
from . import q_functions, q_leads, q_streaming
from .registry import register


@register("salary_annual")
def q_salary_annual(spark, base):
    return q_functions.q_salary_by_period(spark, base).select("o_orderkey", "annual_monthly")


@register("html_to_text")
def q_html_to_text(spark, base):
    """Plain text of every page (script/style/comments excluded, entities decoded)."""
    return spread(table(spark, base, "pages").select("page_id", "html")).select("page_id", html_to_text(F.col("html")).alias("text"))


@register("language_window")
def q_language_window(spark, base):
    return fx.postings(spark, base).select("seq", text.language_window().alias("lang_window"))


@register("csv_params")
def q_csv_params(spark, base):
    raw = F.concat(F.lit(" "), F.col("p_type"), F.lit(" , ,"), F.col("p_name"), F.lit(" "))
    return table(spark, base, "part").select(
        "p_partkey", text.csv_keywords(raw).alias("keywords"), text.csv_list(raw).alias("items"),
        text.csv_paths(raw).alias("paths"))


@register("min_years")
def q_min_years(spark, base):
    t = F.concat(F.col("title"), F.lit(" "), F.col("description"))
    return fx.postings(spark, base).select("seq", experience.min_years(t).alias("min_years"))


@register("title_is_senior")
def q_title_is_senior(spark, base):
    return fx.postings(spark, base).select("seq", experience.title_is_senior("title").alias("title_is_senior"))


@register("mail_context")
def q_mail_context(spark, base):
    return q_leads.q_mailto_candidates(spark, base).select("page_id", "pos", "context")


@register("lead_status")
def q_lead_status(spark, base):
    return q_leads.q_new_leads(spark, base).select("fingerprint", "status")


@register("remote_marker_filter")
def q_remote_marker_filter(spark, base):
    """cards passing the marker test (remote pass only)."""
    cards = pm.card_rows(fx.postings(spark, base), "bumeran", cf.CARD_TEXT_BASE)
    return cards.filter(remote_marker_filter("raw", cf.CARD_TEXT_MARKERS, "is_remote")).select("step", "pos")


@register("known_source")
def q_known_source(spark, base):
    return fx.postings(spark, base).filter(known_source()).select("seq", "source")


@register("required_fields")
def q_required_fields(spark, base):
    cards = pm.card_rows(fx.postings(spark, base), "computrabajo", cf.CARD_FIELDS_BASE)
    return cards.filter(required_fields("title", "href")).select("step", "pos")


@register("unknown_feeds")
def q_unknown_feeds(spark, base):
    """U3 over configured names: every source name of the documents as a configured list; a row per unknown feed."""
    feeds = table(spark, base, "documents").select(F.explode(csv_list(F.col("source"))).alias("feed")).distinct()
    known = spark.createDataFrame([(f,) for f in KNOWN_FEEDS], "feed string")
    return feeds.join(F.broadcast(known), "feed", "left_anti")


@register("stream_dedup_exact")
def q_stream_dedup_exact(spark, base):
    """Keys the table-backed stream saved -- never expires, each exactly once."""
    return q_streaming.q_stream_postings(spark, base).select("fingerprint")
