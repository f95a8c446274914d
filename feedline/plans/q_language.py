"""Registered queries for language detection.

The profile is trained on the even half of ``documents`` (whole texts, label
``lang``) and applied to the whole text of every derived posting; the odd
half of ``documents`` measures accuracy.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.language import detect, fit_profile, language_scores
from ..operators.predicates import language_filter, posting_filter, valid_posting
from ..params import PostingParams
from ..sources import fixtures as fx
from ..sources.tables import spread, table
from .postings_flow import language_detector
from .registry import register

ALLOWED = ("en", "es")


def _profile(spark, base):
    docs = table(spark, base, "documents")
    return fit_profile(spread(docs.select("doc_id", "text", "lang")).filter(F.col("doc_id") % 2 == 0))


def whole_text():
    return F.concat(F.col("title"), F.lit(" "), F.col("description"))


def detected_postings(spark, base):
    p = fx.postings(spark, base)
    return detect(p, _profile(spark, base), whole_text(), "seq")


@register("detect_language")
def q_detect_language(spark, base):
    """Most likely language and its probability for each posting."""
    d = detected_postings(spark, base)
    return d.select("seq", "detected_lang", F.round("detected_prob", 4).alias("detected_prob"))


@register("language_scores")
def q_language_scores(spark, base):
    """Log posterior (unnormalised) per posting and language."""
    s = language_scores(fx.postings(spark, base), _profile(spark, base), whole_text(), "seq")
    return s.select("seq", "lang", F.round("score", 4).alias("score"))


@register("language_filter")
def q_language_filter(spark, base):
    """postings whose language is allowed, unknown, or detected with p < 0.8."""
    return detected_postings(spark, base).filter(language_filter(ALLOWED)).select("seq")


@register("language_accuracy")
def q_language_accuracy(spark, base):
    """Held-out accuracy per true language on the odd half of ``documents`` (whole texts)."""
    docs = spread(table(spark, base, "documents").select("doc_id", "text", "lang")).filter(F.col("doc_id") % 2 == 1)
    d = detect(docs, _profile(spark, base), F.col("text"), "doc_id")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                                 F.count_if(F.col("detected_lang") == F.col("lang")).alias("n_correct"))


@register("posting_filter")
def q_posting_filter(spark, base):
    """the operator with every conjunct, F5 included, over the valid postings."""
    p = PostingParams(keywords=fx.FIXTURE_KEYWORDS, max_years=fx.FIXTURE_MAX_YEARS, max_age_days=fx.FIXTURE_MAX_AGE_DAYS,
                      min_salary=fx.FIXTURE_MIN_SALARY, allowed_languages=ALLOWED, as_of=fx.AS_OF)
    postings = fx.postings(spark, base).filter(valid_posting())
    return posting_filter(postings, p, language_detector(_profile(spark, base))).select("seq")
