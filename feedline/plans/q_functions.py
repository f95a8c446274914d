"""Registered queries for the scalar functions (P*) and predicates (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, experience, salary, text
from ..functions.fingerprint import fingerprint, lead_fingerprint
from ..operators import predicates as pr
from ..params import DEFAULT_BLACKLIST, PostingParams, clean_list
from ..sources import fixtures as fx
from ..sources import search
from ..sources.tables import table
from .registry import register

BLACKLIST = tuple(clean_list(DEFAULT_BLACKLIST))


def _p(spark, base):
    return fx.postings(spark, base)


# ---------------------------------------------------------------- P1 / P2 / P17 / P18

@register("fingerprint")
def q_fingerprint(spark, base):
    return _p(spark, base).select("seq", fingerprint().alias("fingerprint"))


@register("lead_fingerprint")
def q_lead_fingerprint(spark, base):
    g = fx.geo_elements(spark, base).filter(F.col("website").isNotNull())
    return g.select("element_id", lead_fingerprint("name", "website").alias("fingerprint"))


@register("searchable_text")
def q_searchable_text(spark, base):
    return _p(spark, base).select("seq", text.searchable_text().alias("searchable"),
                                  text.language_window().alias("lang_window"))


# ---------------------------------------------------------------- P3 / P4 / P5

def _card_text():
    s = F.col("seq") % 3
    return (F.when(s == 0, F.concat_ws("\n", F.lit("Nuevo"), F.lit("Publicado hace 2 días"), F.col("title"),
                                       F.col("company"), F.col("location")))
            .when(s == 1, F.concat(F.lit("  "), F.col("title"), F.lit("  \n\n"), F.col("company")))
            .otherwise(F.concat(F.lit("Hoy\n"), F.col("title"))))


@register("title_company_lines")
def q_title_company_lines(spark, base):
    tc = text.title_company_lines(_card_text())
    return _p(spark, base).select("seq", tc["title"].alias("title"), tc["company"].alias("company"))


@register("title_company_pipes")
def q_title_company_pipes(spark, base):
    s = F.col("seq") % 3
    line = (F.when(s == 0, F.concat_ws(" | ", "company", "title", "location"))
            .when(s == 1, F.concat(F.col("company"), F.lit(" | "), F.col("title"), F.lit("\nmore | text")))
            .otherwise(F.col("title")))
    tc = text.title_company_pipes(line)
    return _p(spark, base).select("seq", tc["title"].alias("title"), tc["company"].alias("company"))


@register("title_company_at")
def q_title_company_at(spark, base):
    s = F.col("seq") % 4
    raw = (F.when(s == 0, F.concat(F.lit("Programming: "), F.col("title"), F.lit(" at "), F.col("company")))
           .when(s == 1, F.concat(F.col("title"), F.lit(" at "), F.col("company")))
           .when(s == 2, F.concat(F.lit("Ops: "), F.col("title")))
           .otherwise(F.concat(F.lit("Design: "), F.col("title"), F.lit(" at "), F.col("company"),
                               F.lit(" at HQ"))))
    tc = text.title_company_at(raw)
    return _p(spark, base).select("seq", tc["title"].alias("title"), tc["company"].alias("company"))


# ---------------------------------------------------------------- P6 / P7 / P8

@register("epoch_to_ts")
def q_epoch_to_ts(spark, base):
    ev = table(spark, base, "events")
    epoch = F.when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise(F.unix_seconds(F.col("ts").cast("timestamp")))
    return ev.select("event_id", dates.epoch_to_ts(epoch).alias("ts"))


@register("rfc2822_to_ts")
def q_rfc2822_to_ts(spark, base):
    ev = table(spark, base, "events")
    ts = F.col("ts")
    k = F.col("event_id") % 5
    raw = (F.when(k == 0, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
           .when(k == 1, F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
           .when(k == 2, F.concat(F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" -0500")))
           .when(k == 3, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm"), F.lit(" +0100")))
           .otherwise(F.lit("yesterday")))
    return ev.select("event_id", dates.rfc2822_to_ts(raw).alias("ts"))


@register("date_to_ts")
def q_date_to_ts(spark, base):
    ev = table(spark, base, "events")
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return ev.select("event_id", dates.date_to_ts(raw).alias("ts"))


# ---------------------------------------------------------------- P9 / P10

@register("salary_by_period")
def q_salary_by_period(spark, base):
    o = table(spark, base, "orders")
    k = F.col("o_orderkey")
    cur = F.when(k % 3 == 2, F.lit("EUR")).otherwise(F.lit("USD"))
    per = F.when(k % 4 == 0, "annual").when(k % 4 == 1, "monthly").when(k % 4 == 2, "hourly")
    amt = F.when(k % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", salary.salary_by_period(cur, amt, per).alias("monthly"),
                    salary.salary_annual(F.when(k % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") - 100000.0))
                    .alias("annual_monthly"))


# ---------------------------------------------------------------- P11 / P12 / P15 / P16

@register("slugify")
def q_slugify(spark, base):
    return _p(spark, base).select("seq", text.slugify(F.concat(F.lit("  "), F.col("title"), F.lit(" & Co. "))).alias("slug"))


@register("absolutise_url")
def q_absolutise_url(spark, base):
    s = F.col("seq") % 3
    href = (F.when(s == 0, F.concat(F.lit("/empleos/"), F.col("seq").cast("string")))
            .when(s == 1, F.col("url"))
            .otherwise(F.concat(F.lit("oferta-"), F.col("seq").cast("string"))))
    return _p(spark, base).select(
        "seq", text.absolutise_unless_http(href, "https://board-a.example").alias("url_a"),
        text.absolutise_if_rooted(href, "https://board-b.example").alias("url_b"))


@register("search_url")
def q_search_url(spark, base):
    terms = table(spark, base, "part").select(F.col("p_name").alias("term")).distinct()
    return search.search_urls(terms, "celaya", "guanajuato")


@register("title_case_place")
def q_title_case_place(spark, base):
    n = table(spark, base, "nation")
    r = table(spark, base, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    city = F.lower(F.concat(F.col("n_name"), F.lit(" d'or-"), F.col("n_nationkey").cast("string"), F.lit("x")))
    state = F.when(F.col("n_nationkey") % 4 == 0, F.lit("  ")).otherwise(F.lower(F.col("r_name")))
    return j.select("n_nationkey", text.title_case_place(city, state).alias("place"))


# ---------------------------------------------------------------- P14 / P20

@register("remote_flag_text")
def q_remote_flag_text(spark, base):
    s = F.col("seq") % 4
    t = (F.when(s == 0, F.concat(F.col("title"), F.lit(" | Remote")))
         .when(s == 1, F.concat(F.col("title"), F.lit(" | fully rEmOtE")))
         .otherwise(F.col("description")))
    return _p(spark, base).select("seq", text.remote_flag(t).alias("is_remote"))


@register("mailto_address")
def q_mailto_address(spark, base):
    c = table(spark, base, "customer")
    k = F.col("c_custkey") % 5
    name = F.lower(F.regexp_replace("c_name", "#", ""))
    href = (F.when(k == 0, F.concat(F.lit("mailto:"), name, F.lit("@x.example")))
            .when(k == 1, F.concat(F.lit("MAILTO: "), name, F.lit("@x.example ?subject=hi")))
            .when(k == 2, F.lit("mailto:?subject=empty"))
            .when(k == 3, F.concat(F.lit("https://x.example/"), name))
            .otherwise(F.concat(F.lit("mailto:"), name, F.lit("@x.example?cc=a@b.c&subject=x"))))
    return c.select("c_custkey", text.mailto_address(href).alias("email"))


# ---------------------------------------------------------------- P21-P23

@register("required_years")
def q_required_years(spark, base):
    t = F.concat(F.col("title"), F.lit(" "), F.col("description"))
    return _p(spark, base).select(
        "seq", experience.min_years(t).alias("min_years"),
        experience.title_is_senior("title").alias("title_is_senior"),
        experience.required_years().alias("required_years"))


# ---------------------------------------------------------------- F1-F12

def _seqs(df, cond):
    return df.filter(cond).select("seq")


@register("keyword_filter")
def q_keyword_filter(spark, base):
    return _seqs(_p(spark, base), pr.keyword_filter(fx.FIXTURE_KEYWORDS, True))


@register("experience_filter")
def q_experience_filter(spark, base):
    return _seqs(_p(spark, base), pr.experience_filter(fx.FIXTURE_MAX_YEARS))


@register("recency_filter")
def q_recency_filter(spark, base):
    return _seqs(_p(spark, base), pr.recency_filter(fx.FIXTURE_MAX_AGE_DAYS, fx.AS_OF))


@register("blacklist_filter")
def q_blacklist_filter(spark, base):
    return _seqs(_p(spark, base), pr.blacklist_filter(BLACKLIST))


@register("salary_filter")
def q_salary_filter(spark, base):
    return _seqs(_p(spark, base), pr.salary_filter(fx.FIXTURE_MIN_SALARY))


@register("valid_url")
def q_valid_url(spark, base):
    return _p(spark, base).select("seq", pr.valid_url().alias("valid_url"),
                                  pr.known_source().alias("known_source"),
                                  pr.required_fields("title", "url").alias("required_fields"))


@register("filter_funnel")
def q_filter_funnel(spark, base):
    """F8: rows surviving each cumulative stage, in one pass."""
    params = PostingParams(keywords=fx.FIXTURE_KEYWORDS, max_years=fx.FIXTURE_MAX_YEARS, max_age_days=fx.FIXTURE_MAX_AGE_DAYS,
                           min_salary=fx.FIXTURE_MIN_SALARY, as_of=fx.AS_OF)
    return _p(spark, base).filter(pr.valid_posting()).agg(*pr.funnel_counts(params))


@register("quarantine")
def q_quarantine(spark, base):
    """rejected rows with the reason (valid rows go on)."""
    _, rejected = pr.quarantine(_p(spark, base))
    return rejected.select("seq", "reason")
