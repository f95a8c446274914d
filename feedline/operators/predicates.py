"""Fail-open posting predicates and their composition.

Each predicate is a function ``(params) -> Column`` (the filter recipe, X2):
pure, null passes, and ``None`` parameters produce no conjunct at all.
Substring semantics are deliberate ("soc" matches "social"), and an empty
keyword matches everything.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.experience import required_years
from ..functions.text import contains_any, searchable_text
from ..schema import KNOWN_SOURCES, POSTING_COLUMNS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_match(keywords, text: Column | None = None) -> Column:
    """Any keyword (lower-cased) is a substring of the searchable text."""
    text = searchable_text() if text is None else text
    return contains_any(text, [k.lower() for k in keywords])


def keyword_filter(keywords, require_remote: bool = True) -> Column:
    """remote (when required) and any keyword is a substring of title+description."""
    cond = keyword_match(keywords)
    return (F.col("is_remote") & cond) if require_remote else cond


def experience_filter(max_years: int) -> Column:
    """required years unknown or <= max_years."""
    # one reference: unknown (null) compares to null and passes via coalesce
    return F.coalesce(required_years() <= F.lit(max_years), F.lit(True))


def recency_filter(max_days: int, as_of: dt.datetime) -> Column:
    """posted_at unknown or at most ``max_days`` days before ``as_of`` (inclusive).

    Future dates pass.  ``as_of`` is an explicit UTC wall-clock parameter.
    """
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(max_days))
    return F.col("posted_at").isNull() | (F.col("posted_at") >= cutoff)


def blacklist_filter(blacklist) -> Column:
    """no blacklist term is a substring.  Terms are not lower-cased here."""
    if not blacklist:
        return F.lit(True)
    return ~contains_any(searchable_text(), list(blacklist))


def language_filter(allowed, lang="detected_lang", prob="detected_prob",
                    min_prob: float = 0.8) -> Column:
    """pass when detection failed, is unsure, or names an allowed language."""
    l, p = _col(lang), _col(prob)
    return l.isNull() | p.isNull() | (p < F.lit(min_prob)) | l.isin(list(allowed))


def salary_filter(min_salary: float) -> Column:
    """salary unknown or >= min_salary."""
    s = F.col("min_salary_usd_monthly")
    return s.isNull() | (s >= F.lit(float(min_salary)))


def remote_marker_filter(text, markers, is_remote_pass) -> Column:
    """in the remote pass the card text must carry a marker word."""
    return ~_col(is_remote_pass) | contains_any(F.lower(_col(text)), markers)


def valid_url(url="url") -> Column:
    """scheme http:// or https://, case-sensitive."""
    u = _col(url)
    return u.startswith("https://") | u.startswith("http://")


def known_source(source="source") -> Column:
    """the source is in the closed domain."""
    return _col(source).isin(list(KNOWN_SOURCES))


def required_fields(*cols) -> Column:
    """every named text field is non-empty."""
    return reduce(lambda a, b: a & b, [(_col(c).isNotNull() & (F.length(_col(c)) > 0)) for c in cols])


def valid_posting() -> Column:
    """Construction-time validity of a POSTING row (F10, F11, non-null text fields)."""
    return (F.col("title").isNotNull() & F.col("company").isNotNull()
            & F.col("location").isNotNull() & F.col("description").isNotNull()
            & F.col("url").isNotNull() & valid_url() & known_source())


def rejection_reason() -> Column:
    """why a row is not a valid POSTING (null when it is)."""
    return (F.when(F.col("title").isNull() | F.col("company").isNull() | F.col("description").isNull()
                   | F.col("location").isNull(), F.lit("missing_field"))
             .when(F.col("url").isNull() | ~valid_url(), F.lit("bad_url"))
             .when(~known_source(), F.lit("unknown_source")))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """split into (valid rows, rejected rows + ``reason``) instead of silently dropping.

    Both halves come from one projection; write the rejected half to a side
    table (it is what the reference only logged).
    """
    tagged = df.withColumn("reason", rejection_reason())
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


#: Why a whole response gave nothing.
RESPONSE_REASONS = ("empty_response", "not_parsable", "wrong_shape")
EMPTY, NOT_PARSABLE, WRONG_SHAPE = RESPONSE_REASONS


def finish(df: DataFrame, with_rejects: bool = False) -> DataFrame:
    """The last step of a feed reader: POSTING rows whose fields all parsed (``__ok``, where given) and are valid.

    A row whose ``bad`` (where given) is set stands for a whole response and says why it gave nothing.
    With ``with_rejects`` the other rows stay and say why (``reason``), for the quarantine table (F14).
    """
    reason = rejection_reason()
    if "__ok" in df.columns:
        reason = F.when(~F.coalesce(F.col("__ok"), F.lit(False)), F.lit("malformed")).otherwise(reason)
    if "bad" in df.columns:
        reason = F.coalesce(F.col("bad"), reason)
    tagged = df.select(*POSTING_COLUMNS, reason.alias("reason"))
    return tagged if with_rejects else tagged.filter(F.col("reason").isNull()).drop("reason")


def cheap_conjuncts(p) -> list[tuple[str, Column]]:
    """F1-F4, F6 in the reference's order; absent parameters emit nothing."""
    out = [("relevant", keyword_filter(p.keywords, p.require_remote))]
    if p.max_years is not None:
        out.append(("experience", experience_filter(p.max_years)))
    if p.max_age_days is not None:
        out.append(("recent", recency_filter(p.max_age_days, p.as_of)))
    if p.blacklist is not None:
        out.append(("not_blacklisted", blacklist_filter(p.blacklist)))
    if p.min_salary is not None:
        out.append(("salary", salary_filter(p.min_salary)))
    return out


def funnel_counts(p) -> list[Column]:
    """F8: aggregates that count, in one pass, the rows left after each cumulative stage."""
    out, acc = [F.count(F.lit(1)).alias("n_total")], F.lit(True)
    for stage, cond in cheap_conjuncts(p):
        acc = acc & cond
        out.append(F.count_if(acc).alias(f"n_{stage}"))
    return out


def posting_filter(df: DataFrame, p, detector=None) -> DataFrame:
    """the conjunction F1..F6 as one Filter.

    The cheap conjuncts run first; language detection (A7, a join) is only
    computed for the survivors, then F5 is applied.  The conjunction is
    order-free, so the result equals the reference's sequence of list filters.
    A language list without a detector is an error, not a filter that is off;
    ``allowed_languages=None`` turns F5 off.
    """
    if p.allowed_languages is not None and detector is None:
        raise ValueError("allowed_languages needs a language profile; pass None to do without the language filter")
    conj = [c for _, c in cheap_conjuncts(p)]
    out = df.filter(reduce(lambda a, b: a & b, conj)) if conj else df
    if p.allowed_languages is not None:
        cols = out.columns
        out = detector(out).filter(language_filter(p.allowed_languages)).select(*cols)
    return out
