"""Plan-shape checks: the properties the scale design relies on."""

import os

import pytest
from pyspark.sql import functions as F

from feedline.plans.catalog import QUERIES
from feedline.operators.dedup import dedup_last_value_first_position
from feedline.operators.joins import seen_keys, within_radius

from .conftest import SF_SMALL

# These run whole jobs (streams, landed feeds, the store) when they are built.
STREAMING = {"stream_postings", "stream_dedup_exact", "stream_dedup_bounded", "late_postings", "stream_leads", "digest_log", "union_feeds"}
# The only queries allowed to run Python on the workers (HTML trees, X3; language scores inside the row, A7).
PYTHON_OK = {"src_thread_comments", "src_html_cards", "src_html_list", "html_to_text", "mailto_candidates",
             "mail_context", "hr_context", "best_email", "new_leads", "lead_status", "scan_unnotified_leads",
             "lead_digest_text", "detect_language", "language_scores", "language_filter", "language_accuracy", "posting_filter"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMING))
def test_no_cartesian_and_python_only_where_needed(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    if key not in PYTHON_OK:
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_bounding_box_reaches_the_parquet_scan(spark, tmp_dir):
    path = os.path.join(tmp_dir, "points")
    spark.range(1000).select(F.col("id"), (F.col("id") % 90 / 10.0).alias("latitude"),
                             (F.col("id") % 180 / 10.0 - 9).alias("longitude")).write.parquet(path)
    plan = within_radius(spark.read.parquet(path), 4.0, 0.0, 50.0).select("id")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(latitude), IsNotNull(longitude), GreaterThanOrEqual(latitude" in plan


def test_dedup_aggregates_partially_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", "x") for i in range(30)], "seq long, fingerprint string, v string")
    plan = _plan(dedup_last_value_first_position(df))
    # a partial aggregate below the exchange and a final one above it
    assert plan.count("Aggregate") >= 2 and "Exchange hashpartitioning(fingerprint" in plan


def test_history_semi_join_broadcasts_only_a_counted_small_batch(spark):
    hist = spark.range(100000).select(F.col("id").cast("string").alias("fingerprint"))
    batch = spark.range(10).select(F.col("id").cast("string").alias("fingerprint"))
    assert "BroadcastExchange" in _plan(seen_keys(hist, batch, batch_key_rows=10))
    big = seen_keys(hist, batch, batch_key_rows=10 ** 9)
    assert "BroadcastExchange" not in big._jdf.queryExecution().sparkPlan().toString()


def test_scenario_reads_the_documents_once_and_contacts_the_pages_once(spark):
    assert _plan(QUERIES["pending_count"](spark, SF_SMALL)).count("documents.parquet") == 0  # read from one written batch
    plan = QUERIES["best_email"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    html = [line for line in plan.splitlines() if "FileScan" in line and "pages.parquet" in line and "html" in line]
    assert len(html) == 1


def test_keyword_list_of_any_length_is_one_filter(spark):
    plan = _plan(QUERIES["keyword_theta"](spark, SF_SMALL))
    assert "NestedLoop" not in plan
