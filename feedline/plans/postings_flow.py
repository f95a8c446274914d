"""The postings run as one plan over landed feeds.

registry readers (X1) -> union in configured order (U1) -> F1-F4, F6 as one
Filter -> language detection on the survivors (A7) -> F5 -> one row per
fingerprint (A1) -> ``Store.run``: retry pending (K5), J1/J2/J3, digest
(W1/A6) through ``send`` (K4), mark (J4) -- in that order (K6).

The filter funnel (F8) rides along as an ``Observation`` on the same scan:
no extra pass, the counts are there once the run's write has executed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..operators.dedup import dedup_last_value_first_position
from ..operators.language import Profile, detect
from ..operators.predicates import funnel_counts, posting_filter
from ..params import PostingParams
from ..sources import fs
from ..sources.registry import feeds_root, union_feeds
from .state import RunReport, Send, Store


def observe_funnel(postings: DataFrame, params: PostingParams, name: str = "funnel") -> tuple[DataFrame, Observation]:
    """F8: rows surviving each cumulative stage, observed on the way through (one pass)."""
    obs = Observation(name)
    return postings.observe(obs, *funnel_counts(params)), obs


def language_detector(profile: Profile | None):
    """X4's detector over whole texts, or None without a profile."""
    if profile is None:
        return None
    text = F.concat(F.col("title"), F.lit(" "), F.col("description"))
    return lambda df: detect(df, profile, text, "seq")


def relevant_batch(postings: DataFrame, params: PostingParams, profile: Profile | None = None) -> DataFrame:
    """F7 then A1 on the fingerprint; F5 needs a language profile where ``params`` asks for it."""
    kept = posting_filter(postings, params, language_detector(profile))
    return dedup_last_value_first_position(kept.withColumn("fingerprint", fingerprint()))


def run_postings(spark: SparkSession, landing_root: str, store: Store, run_id: int, params: PostingParams,
                 send: Send, profile: Profile | None = None, quarantine: str | None = None
                 ) -> tuple[RunReport, dict, dict]:
    """One cron-equivalent run: (run report, feeds that failed to read, funnel counts).

    Rejected feed items go to ``quarantine``/run_id=N, if given.
    """
    rejects = f"{quarantine}/run_id={run_id}" if quarantine else None
    root = feeds_root(spark)
    postings, failed = union_feeds(spark, landing_root, params.enabled_feeds, params.search, rejects, root=root)
    postings, funnel = observe_funnel(postings, params)
    report = store.run(relevant_batch(postings, params, profile), run_id, params.digest_size, send)
    fs.delete(spark, root)  # the run has committed
    return report, failed, funnel.get
