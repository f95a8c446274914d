"""Registered queries for dedup, history joins, digest and the three-run state scenario.

Scenario over the derived postings (flagship filter F1 + F3), whose places
start at 0 again in each run:
run 0 saves its deduplicated batch and marks the first N it announced;
run 1 first retries what run 0 left pending (K5), then saves what is new
against run 0 (J1/J2/J3) and marks the first N of those;
run 2 brings nothing and retries the oldest of what is pending.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digest as dg
from ..operators.dedup import dedup_last_value_first_position
from ..operators.joins import seen_keys
from ..operators.predicates import keyword_filter, recency_filter, valid_posting
from ..schema import KNOWN_SOURCES, POSTING_COLUMNS
from ..sources import fixtures as fx
from ..streaming.flows import checkpoint_path, digest_sink
from .registry import register
from .state import Store, insert_ignore, marks, pending

N = 10
COLS = [*POSTING_COLUMNS, "fingerprint"]


def _filtered(spark, base):
    """The relevant rows of both runs, written once: every step of the scenario reads these."""
    cond = valid_posting() & keyword_filter(fx.FIXTURE_KEYWORDS, True) & recency_filter(
        fx.FIXTURE_MAX_AGE_DAYS, fx.AS_OF)
    rows = fx.postings(spark, base).filter(cond).select(*COLS, "run_no")
    return rows.withColumn("seq", F.floor(F.col("seq") / 30) * 15 + F.col("seq") % 15).checkpoint()


def _batches(spark, base):
    """Each run's deduplicated batch."""
    f = _filtered(spark, base)
    return [dedup_last_value_first_position(f.filter(F.col("run_no") == r).drop("run_no")) for r in (0, 1)]


def scenario(spark, base):
    b0, b1 = _batches(spark, base)
    saved0 = b0.withColumn("run_id", F.lit(0).cast("bigint"))
    marks0 = marks(saved0, N, 0, "new")
    pend1 = pending(saved0, marks0)
    marks1r = marks(pend1, N, 1, "retry")
    new1 = insert_ignore(b1, saved0)
    saved1 = new1.withColumn("run_id", F.lit(1).cast("bigint"))
    marks1n = marks(new1, N, 1, "new")
    table = saved0.unionByName(saved1)
    notes1 = marks0.unionByName(marks1r).unionByName(marks1n)
    marks2r = marks(pending(table, notes1), N, 2, "retry")
    return dict(b0=b0, b1=b1, new1=new1, table=table, notes=notes1.unionByName(marks2r))


@register("dedup_batch_last")
def q_dedup_batch_last(spark, base):
    p = fx.postings(spark, base).filter(valid_posting()).select(*COLS)
    return dedup_last_value_first_position(p)


@register("seen_semi")
def q_seen_semi(spark, base):
    """J1 over the unfiltered valid runs: run-1 keys already in run 0."""
    p = fx.postings(spark, base).filter(valid_posting())
    return seen_keys(p.filter(F.col("run_no") == 0), p.filter(F.col("run_no") == 1))


@register("insert_ignore")
def q_insert_ignore(spark, base):
    return scenario(spark, base)["table"].select("fingerprint", "seq", "run_id", "title", "source")


@register("inserted_count")
def q_inserted_count(spark, base):
    return scenario(spark, base)["table"].groupBy("run_id").agg(F.count(F.lit(1)).alias("inserted"))


@register("mark_notified")
def q_mark_notified(spark, base):
    return scenario(spark, base)["notes"]


@register("retry_pending")
def q_retry_pending(spark, base):
    """K5: what each run retried: the oldest pending rows, by the run that saved them, then their place."""
    s = scenario(spark, base)
    saved = s["table"].select("fingerprint", F.col("run_id").alias("saved_run"), "seq")
    return s["notes"].filter("kind = 'retry'").join(saved, "fingerprint").select("run_id", "saved_run", "seq", "fingerprint")


@register("digest_log")
def q_digest_log(spark, base):
    """K4 + K6: the digests that the store's runs delivered, the second run twice (a replay)."""
    b0, b1 = _batches(spark, base)
    root = checkpoint_path(spark, "digest-log")
    store, send = Store(spark, f"{root}/state"), digest_sink(f"{root}/digests", N)
    for run, batch in ((0, b0), (1, b1), (1, b1), (2, b1.limit(0))):
        store.run(batch, run, N, send)
    log = spark.read.parquet(f"{root}/digests")
    return log.select(F.col("run_id").cast("bigint").alias("run_id"), "kind", "n_items", "n_total", "text")


class BrokenOff(RuntimeError):
    """What a run of the queries below ends with."""


def _after_break(spark, base):
    """The store after a first run whose delivery broke it off, a second one that took up its rows, and a third with nothing new."""
    b0, b1 = _batches(spark, base)
    store = Store(spark, f"{checkpoint_path(spark, 'after-break')}/state")

    def breaks(rows, total, run_id, kind):
        raise BrokenOff(kind)

    try:
        store.run(b0, 0, N, breaks)
    except BrokenOff:
        pass
    for run, batch in ((1, b1), (2, b1.limit(0))):
        store.run(batch, run, N, lambda *_: True)
    return store


@register("retry_after_break")
def q_retry_after_break(spark, base):
    """K3 + K5 + K6 through the store: what was announced, by which run, and which run had saved it."""
    store = _after_break(spark, base)
    saved = store.rows().select("fingerprint", F.col("run_id").alias("in_run"), "seq")
    notes = store.notifications().select("fingerprint", "run_id", "kind", "saved_run")
    return notes.join(saved, "fingerprint").filter("in_run = saved_run").select("run_id", "kind", "saved_run", "seq", "fingerprint")


@register("pending_after_break")
def q_pending_after_break(spark, base):
    """S15 + K1 through the store: what is still to be announced after those runs, by the ledger."""
    return _after_break(spark, base).pending().select("fingerprint", "run_id", "title", "url", "source")


@register("scan_unnotified")
def q_scan_unnotified(spark, base):
    s = scenario(spark, base)
    return pending(s["table"], s["notes"]).filter(valid_posting()).select(
        "fingerprint", "title", "company", "location", "url", "source", "is_remote", "description")


@register("pending_count")
def q_pending_count(spark, base):
    s = scenario(spark, base)
    return pending(s["table"], s["notes"]).filter(valid_posting()).agg(F.count(F.lit(1)).alias("pending"))


@register("digest_slice")
def q_digest_slice(spark, base):
    return dg.digest_slice(scenario(spark, base)["new1"], N).select("seq", "fingerprint", "title")


@register("digest_line")
def q_digest_line(spark, base):
    return scenario(spark, base)["new1"].select("seq", dg.posting_line().alias("line"))


@register("digest_text")
def q_digest_text(spark, base):
    return dg.digest_text(scenario(spark, base)["new1"], N, dg.posting_line(), dg.POSTING_HEADER)


@register("overflow_count")
def q_overflow_count(spark, base):
    new1 = scenario(spark, base)["new1"]
    return new1.agg(F.count(F.lit(1)).alias("n_total")).select(
        "n_total", dg.overflow_count(F.col("n_total"), N).alias("overflow"))


@register("counts_by_source")
def q_counts_by_source(spark, base):
    return fx.postings(spark, base).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("unknown_sources")
def q_unknown_sources(spark, base):
    """configured/observed source names minus the known domain (set difference)."""
    known = spark.createDataFrame([(s,) for s in KNOWN_SOURCES], "source string")
    return fx.postings(spark, base).select("source").distinct().exceptAll(known)
