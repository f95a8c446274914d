import datetime as dt

from pyspark.sql import functions as F

from feedline.operators import predicates as pr
from feedline.operators.joins import keyword_semi
from feedline.params import PostingParams, clean_list, keywords_list, unknown_feeds

AS_OF = dt.datetime(2024, 1, 31)
SCHEMA = ("seq long, title string, company string, location string, url string, source string, "
          "is_remote boolean, description string, posted_at timestamp_ntz, min_salary_usd_monthly double")


def _df(spark, rows):
    base = dict(seq=0, title="Dev", company="Acme", location="Remote", url="https://a", source="remoteok",
                is_remote=True, description="", posted_at=None, min_salary_usd_monthly=None)
    full = []
    for i, r in enumerate(rows):
        d = dict(base, seq=i)
        d.update(r)
        full.append(tuple(d[k] for k in base))
    return spark.createDataFrame(full, SCHEMA)


def _seqs(df, cond):
    return sorted(r[0] for r in df.filter(cond).select("seq").collect())


def test_keyword_filter_is_substring_and_requires_remote(spark):
    df = _df(spark, [dict(title="SOC Analyst"), dict(description="social media"), dict(title="Chef"),
                     dict(title="Python dev", is_remote=False)])
    assert _seqs(df, pr.keyword_filter(["soc", "python"], True)) == [0, 1]
    assert _seqs(df, pr.keyword_filter(["soc", "python"], False)) == [0, 1, 3]


def test_empty_keyword_matches_everything(spark):
    df = _df(spark, [dict(title="Chef"), dict(title="Baker")])
    assert keywords_list("python,,") == ["python", "", ""]
    assert _seqs(df, pr.keyword_filter(keywords_list("python,"), True)) == [0, 1]


def test_recency_is_inclusive_future_and_unknown_pass(spark):
    df = _df(spark, [dict(posted_at=AS_OF - dt.timedelta(days=30)),
                     dict(posted_at=AS_OF - dt.timedelta(days=30, seconds=1)),
                     dict(posted_at=AS_OF + dt.timedelta(days=3)), dict(posted_at=None)])
    assert _seqs(df, pr.recency_filter(30, AS_OF)) == [0, 2, 3]


def test_blacklist_terms_are_not_lowercased_in_predicate(spark):
    df = _df(spark, [dict(description="Requires Security Clearance"), dict(description="fine")])
    assert _seqs(df, pr.blacklist_filter(["security clearance"])) == [1]
    assert _seqs(df, pr.blacklist_filter(["Security Clearance"])) == [0, 1]  # text is lowered, term is not
    assert _seqs(df, pr.blacklist_filter([])) == [0, 1]


def test_salary_boundary_and_unknown(spark):
    df = _df(spark, [dict(min_salary_usd_monthly=2000.0), dict(min_salary_usd_monthly=1999.99),
                     dict(min_salary_usd_monthly=None), dict(min_salary_usd_monthly=0.0)])
    assert _seqs(df, pr.salary_filter(2000)) == [0, 2]


def test_experience_filter(spark):
    df = _df(spark, [dict(title="Senior Dev"), dict(title="Senior Dev", description="2 years"),
                     dict(title="Dev", description="5+ years"), dict(title="Junior Dev", description="10 years"),
                     dict(title="Dev")])
    assert _seqs(df, pr.experience_filter(3)) == [1, 3, 4]


def test_language_filter_fail_open(spark):
    df = spark.createDataFrame([(0, "de", 0.99), (1, "de", 0.5), (2, None, None), (3, "es", 0.95)],
                               "seq long, detected_lang string, detected_prob double")
    assert _seqs(df, pr.language_filter(["en", "es"])) == [1, 2, 3]


def test_valid_url_is_case_sensitive(spark):
    df = _df(spark, [dict(url="https://a"), dict(url="HTTPS://a"), dict(url="ftp://a"), dict(url="http://a")])
    assert _seqs(df, pr.valid_url()) == [0, 3]


def test_posting_filter_drops_absent_conjuncts(spark):
    df = _df(spark, [dict(title="python dev", description="10 years", min_salary_usd_monthly=10.0),
                     dict(title="python dev")])
    p_all = PostingParams(keywords=("python",), max_years=3, max_age_days=None, blacklist=None,
                          allowed_languages=None, min_salary=100.0, as_of=AS_OF)
    assert _seqs(pr.posting_filter(df, p_all), F.lit(True)) == [1]
    p_none = PostingParams(keywords=("python",), max_years=None, max_age_days=None, blacklist=None,
                           allowed_languages=None, min_salary=None, as_of=AS_OF)
    assert _seqs(pr.posting_filter(df, p_none), F.lit(True)) == [0, 1]


def test_keyword_theta_join_equals_or_chain(spark):
    df = _df(spark, [dict(title="python dev"), dict(title="chef"), dict(description="devops")])
    terms = ["python", "devops"] + [f"zz{i}" for i in range(60)]
    semi = sorted(r[0] for r in keyword_semi(df, terms).select("seq").collect())
    assert semi == _seqs(df, pr.keyword_match(terms)) == [0, 2]
    anti = sorted(r[0] for r in keyword_semi(df, terms, how="left_anti")
                  .select("seq").collect())
    assert anti == [1]


def test_params_parsing_and_validation():
    assert clean_list(" A, ,b ") == ["a", "b"]
    assert unknown_feeds("remoteok,bogus, Other") == ["bogus", "other"]
    try:
        PostingParams(enabled_feeds=("nope",))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
    try:
        PostingParams(jobspy_terms=tuple("abcdef"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_posting_filter_takes_a_long_keyword_list_in_one_filter(spark):
    df = _df(spark, [dict(title="python dev"), dict(title="chef"), dict(title="python", is_remote=False)])
    kws = ("python",) + tuple(f"zz{i}" for i in range(60))
    p = PostingParams(keywords=kws, max_years=None, max_age_days=None, blacklist=None,
                      allowed_languages=None, min_salary=None, as_of=AS_OF)
    out = pr.posting_filter(df, p)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert _seqs(out, F.lit(True)) == [0]


def test_long_term_lists_equal_the_plain_test_without_a_nested_loop(spark):
    import random

    from feedline.functions.text import contains_any
    rng = random.Random(5)
    terms = [f"{rng.choice(['py', 'ñu', 'x'])}{rng.randrange(10**6)}" for _ in range(100_000)]
    texts = ["", None, "nothing here", *(" ".join([*rng.sample(terms, 1), "tail"]) for _ in range(20)), *(f"py{rng.randrange(10**6)}é" for _ in range(80))]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, t string")
    out = df.select("seq", contains_any("t", terms).alias("found"))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    known = set(terms)
    want = {i: None if t is None else any(t[a:b] in known for a in range(len(t)) for b in range(a + 1, len(t) + 1)) for i, t in enumerate(texts)}
    assert {r.seq: r.found for r in out.collect()} == want and sum(v is True for v in want.values()) >= 20
    rows = _df(spark, [dict(title="python dev"), dict(title="chef"), dict(title="x" + terms[0])])
    p = PostingParams(keywords=("python",), max_years=None, max_age_days=None, blacklist=tuple(terms), allowed_languages=None, min_salary=None, as_of=AS_OF)
    assert _seqs(pr.posting_filter(rows, p), F.lit(True)) == [0]
    assert df.filter(contains_any("t", ["", *terms])).count() == len(texts) - 1
