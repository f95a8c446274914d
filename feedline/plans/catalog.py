"""Registered queries: each ``(spark, base_dir) -> DataFrame`` over the whole driver tables.

The postings/leads/crawl shapes come from the derived views of
``sources/fixtures.py``; every query is the library operator applied to
them, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..operators.dedup import new_last_value_first_position
from ..operators.predicates import keyword_filter, recency_filter, valid_posting
from ..schema import POSTING_COLUMNS
from ..sources import fixtures as fx
from ..sources import json_feeds, payloads

OUT_COLS = [*POSTING_COLUMNS, "fingerprint"]

from .registry import QUERIES, packed, register  # noqa: F401


def _flagship_filter() -> F.Column:
    return keyword_filter(fx.FIXTURE_KEYWORDS, True) & recency_filter(fx.FIXTURE_MAX_AGE_DAYS, fx.AS_OF)


@register("new_postings")
def new_postings(spark: SparkSession, base: str) -> DataFrame:
    """Remote postings matching the keywords, recent, deduplicated, not seen in run 0."""
    p = fx.postings(spark, base).filter(valid_posting() & _flagship_filter())
    # Batch (run 1) and history (run 0) come from the same table here, so the
    # in-batch dedup (A1) and the anti join with history (J2) are one
    # aggregation: one scan, one shuffle.  The join form (J1/J2 against a
    # separate history table) is exercised by seen_semi / insert_ignore.
    return new_last_value_first_position(p.select(*OUT_COLS, "run_no"), 1).select(*OUT_COLS)


# ---------------------------------------------------------------- S1-S4, S12: JSON feeds

def _all_postings(spark, base):
    return fx.postings(spark, base)


@register("src_json_array")
def src_json_array(spark, base):
    p = _all_postings(spark, base)
    return packed(json_feeds.read_json_array(payloads.json_array_payloads(p)).withColumn("fingerprint", fingerprint()))


@register("src_json_envelope")
def src_json_envelope(spark, base):
    p = _all_postings(spark, base)
    return packed(json_feeds.read_json_envelope(payloads.json_envelope_payloads(p)).withColumn(
        "fingerprint", fingerprint()))


@register("src_json_salaried")
def src_json_salaried(spark, base):
    p = _all_postings(spark, base)
    return packed(json_feeds.read_json_salaried(payloads.json_salaried_payloads(p)).withColumn(
        "fingerprint", fingerprint()))


@register("src_thread_comments")
def src_thread_comments(spark, base):
    p = _all_postings(spark, base)
    return packed(json_feeds.read_thread_comments(payloads.thread_payloads(p)))


@register("src_geo_elements")
def src_geo_elements(spark, base):
    return packed(json_feeds.read_geo_elements(payloads.geo_payloads(fx.geo_elements(spark, base))))


# Importing the query modules registers their queries.
from . import q_functions  # noqa: E402,F401
from . import q_state  # noqa: E402,F401
from . import q_leads  # noqa: E402,F401
from . import q_feeds  # noqa: E402,F401
from . import q_language  # noqa: E402,F401
from . import q_streaming  # noqa: E402,F401
from . import q_more  # noqa: E402,F401
