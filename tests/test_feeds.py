import datetime as dt
import json

from pyspark.sql import functions as F

from feedline.sources import card_feeds as cf
from feedline.sources import json_feeds, markup_feeds


def _payloads(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)],
                                 "payload_id long, payload string")


def _by_title(df):
    return {r["title"]: r for r in df.collect()}


def test_json_array_feed(spark):
    doc = [{"legal": "meta"}, 42,
           {"position": "Backend Dev", "company": "Acme", "slug": "backend-dev-1", "description": "d",
            "epoch": 1700000000, "salary_min": 120000},
           {"position": "No Company", "slug": "x"},                     # missing key -> default ""
           {"position": None, "company": "A", "slug": "y"},              # explicit null -> dropped
           {"position": "Zero Pay", "company": "B", "slug": "z", "salary_min": 0, "epoch": 0}]
    got = _by_title(json_feeds.read_json_array(_payloads(spark, doc)))
    assert set(got) == {"Backend Dev", "No Company", "Zero Pay"}
    b = got["Backend Dev"]
    assert b["url"] == "https://remoteok.com/remote-jobs/backend-dev-1" and b["location"] == "Remote"
    assert b["min_salary_usd_monthly"] == 10000.0 and b["posted_at"] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got["No Company"]["company"] == "" and got["No Company"]["description"] == ""
    assert got["Zero Pay"]["min_salary_usd_monthly"] is None and got["Zero Pay"]["posted_at"] is None
    assert b["seq"] < got["No Company"]["seq"] < got["Zero Pay"]["seq"]


def test_json_envelope_feed(spark):
    doc = {"jobs": [{"id": 1, "title": "Dev", "company_name": "A", "url": "https://r/1"},
                    {"id": 2, "title": "Ops", "company_name": "B", "url": "https://r/2",
                     "candidate_required_location": "Europe"},
                    {"id": 3, "title": "Bad", "company_name": "C", "url": "ftp://r/3"}]}
    got = _by_title(json_feeds.read_json_envelope(_payloads(spark, doc, {"other": []}, "not json")))
    assert set(got) == {"Dev", "Ops"}
    assert got["Dev"]["location"] == "Remote" and got["Ops"]["location"] == "Europe"


def test_json_salaried_feed(spark):
    doc = {"jobs": [
        {"title": "A", "companyName": "X", "applicationLink": "", "guid": "https://g/1",
         "locationRestrictions": ["Mexico", "US"], "pubDate": 1700000000, "currency": "USD",
         "minSalary": 120000, "salaryPeriod": "annual"},
        {"title": "B", "companyName": "X", "applicationLink": "https://a/2", "locationRestrictions": [],
         "pubDate": "Tue, 07 Jul 2026 10:00:00 GMT", "currency": "USD", "minSalary": 0, "salaryPeriod": "monthly"},
        {"title": "C", "companyName": "X", "applicationLink": "https://a/3", "pubDate": "garbage",
         "currency": "EUR", "minSalary": 5000, "salaryPeriod": "monthly"},
        {"title": "D", "companyName": "X", "applicationLink": "https://a/4", "pubDate": "1700000000",
         "currency": "USD", "minSalary": 50, "salaryPeriod": "hourly"}]}
    got = _by_title(json_feeds.read_json_salaried(_payloads(spark, doc)))
    assert got["A"]["url"] == "https://g/1" and got["A"]["location"] == "Mexico"
    assert got["A"]["min_salary_usd_monthly"] == 10000.0
    assert got["A"]["posted_at"] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got["B"]["location"] == "Remote" and got["B"]["min_salary_usd_monthly"] == 0.0
    assert got["B"]["posted_at"] == dt.datetime(2026, 7, 7, 10)
    assert got["C"]["posted_at"] is None and got["C"]["min_salary_usd_monthly"] is None
    assert got["D"]["posted_at"] is None and got["D"]["min_salary_usd_monthly"] is None  # numeric string


def test_thread_comments_feed(spark):
    thread = {"id": 1, "children": [
        {"id": 11, "text": "Acme | Backend Engineer | REMOTE<p>We use Python &amp; Go</p>", "created_at_i": 1700000000},
        {"id": 12, "text": None}, {"id": 13, "text": ""},
        {"id": 14, "text": "Just a line about <i>onsite</i> work", "created_at_i": 0}]}
    got = {r["url"]: r for r in json_feeds.read_thread_comments(_payloads(spark, thread)).collect()}
    a = got["https://news.ycombinator.com/item?id=11"]
    assert (a["title"], a["company"], a["is_remote"], a["location"]) == ("Backend Engineer", "Acme", True, "Remote")
    assert "<" not in a["description"] and "Python & Go" in a["description"]
    b = got["https://news.ycombinator.com/item?id=14"]
    assert (b["title"], b["company"], b["is_remote"], b["posted_at"]) == (
        "Just a line about onsite work", "", False, None)
    assert len(got) == 2


def test_latest_thread_uses_date_not_rank(spark):
    from feedline.operators.windows import newest
    hits = spark.createDataFrame([(1, "old", dt.datetime(2020, 3, 1)), (2, "new", dt.datetime(2026, 7, 1))],
                                 "object_id long, title string, created_at timestamp_ntz")
    assert newest(hits, "created_at", "object_id", ["object_id", "title"]).first()["title"] == "new"


def test_geo_elements(spark):
    doc = {"elements": [
        {"type": "node", "lat": 20.5, "lon": -100.8, "tags": {"name": "A", "website": "https://a"}},
        {"type": "way", "center": {"lat": 20.6, "lon": -100.7}, "tags": {"name": "B", "website": "https://b"}},
        {"type": "node", "lat": 20.5, "lon": -100.8, "tags": {"name": "C"}},
        {"type": "node", "tags": {"name": "D", "website": "https://d"}},
        {"type": "node", "lat": 1, "lon": 1, "tags": {"name": "", "website": "https://e"}}]}
    got = {r["name"]: (r["latitude"], r["longitude"]) for r in
           json_feeds.read_geo_elements(_payloads(spark, doc)).collect()}
    assert got == {"A": (20.5, -100.8), "B": (20.6, -100.7)}


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>x</title>
<item><title>Programming: Senior Dev at Acme</title><link>https://w/1</link>
<description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Tue, 07 Jul 2026 10:00:00 +0000</pubDate></item>
<item><title>Design: Lead Designer</title><link></link><guid isPermaLink="false">https://w/2</guid>
<pubDate>not a date</pubDate></item>
<item><title></title><link>https://w/3</link></item>
</channel></rss>"""


def test_rss_feed(spark):
    got = _by_title(markup_feeds.read_rss(_payloads(spark, RSS, "<rss><channel><item>")))
    assert set(got) == {"Senior Dev", "Lead Designer"}
    assert got["Senior Dev"]["company"] == "Acme" and got["Senior Dev"]["description"] == "<p>Hi</p>"
    assert got["Senior Dev"]["posted_at"] == dt.datetime(2026, 7, 7, 10)
    assert got["Lead Designer"]["url"] == "https://w/2" and got["Lead Designer"]["posted_at"] is None


def _card(href, title, company, remote, tip="t"):
    badge = '<i class="perk-remote_full"></i>' if remote else ""
    return (f'<a class="results-item" href="{href}" title="{tip}"><div class="results-list-info">'
            f'<h4 class="results-list-title"><strong>{title}</strong></h4><div class="size0">'
            f'<strong>{company}</strong></div></div>{badge}</a>')


def test_html_cards_filter_then_dedup_across_pages(spark):
    p1 = _card("https://g/1", "Dev", "A", False) + _card("https://g/2", "Ops", "B", True, "x &amp; y")
    p2 = _card("https://g/1", "Dev again", "A", True) + _card("https://g/2", "Ops dup", "B", True)
    got = _by_title(markup_feeds.read_result_cards(_payloads(spark, p1, p2)))
    # the non-remote card on page 1 did not claim its URL; the remote one on page 2 is kept
    assert set(got) == {"Ops", "Dev again"} and got["Ops"]["description"] == "x & y"


def test_html_list(spark):
    page = ('<ul><li class="list-group-item"><a class="stretched-link" hx-get="/hiring/jobs/1-a">  SOC Analyst </a></li>'
            '<li class="list-group-item"><a class="stretched-link" hx-get="/blog/2">Blog</a></li>'
            '<li class="other"><a class="stretched-link" hx-get="/hiring/jobs/3">X</a></li></ul>')
    got = _by_title(markup_feeds.read_list_links(_payloads(spark, page)))
    assert list(got) == ["SOC Analyst"] and got["SOC Analyst"]["url"] == "https://foorilla.com/hiring/jobs/1-a"
    assert got["SOC Analyst"]["company"] == ""


def test_tabular_passes_and_source_map(spark):
    rows = spark.createDataFrame(
        [(1, "LinkedIn", "Dev", "A", None, "https://l/1", None, "2024-01-05"),
         (2, "zip_recruiter", "Ops", "B", "NY", "https://z/2", "d", "2024-01-05"),
         (3, "indeed", None, "C", "NY", "https://i/3", "d", None)],
        "seq long, site string, title string, company string, location string, job_url string, "
        "description string, date_posted string")
    out = cf.read_tabular_passes(spark, rows, rows)
    got = [(r["seq"]["pos"], r["source"], r["is_remote"], r["location"], r["posted_at"]) for r in out.orderBy("seq").collect()]
    assert got == [(1, "linkedin", True, "Remote", dt.datetime(2024, 1, 5)),
                   (1, "linkedin", False, "Remote", dt.datetime(2024, 1, 5))]  # the local pass comes second


CARD_SCHEMA = ("feed string, step long, pos long, href string, raw string, title string, company string, "
               "text string, is_remote boolean, blocked boolean")


def test_card_text_claims_href_before_marker_test(spark):
    cards = spark.createDataFrame([
        ("bumeran", 0, 0, "/e/1", "Desarrollador Python\nAcme\nPresencial", "", "", "", True, False),
        ("bumeran", 1, 0, "/e/1", "Desarrollador Python\nAcme\nCelaya", "", "", "", False, False),
        ("bumeran", 1, 1, "/e/2", "Programador Java\nBeta\nCelaya", "", "", "", False, False),
        ("bumeran", 2, 0, "/e/3", "Programador Go\nGamma\nHome office", "", "", "", True, False),
        ("bumeran", 3, 0, "/e/4", "Blocked page card\nX\nremoto", "", "", "", True, True),
        ("bumeran", 4, 0, "/e/5", "After the block\nY\nremoto", "", "", "", True, False),
    ], CARD_SCHEMA)
    got = _by_title(cf.read_card_text(cards, city="celaya"))
    # /e/1 was rejected in the remote pass (no marker) and is lost to the local pass (trap 3);
    # the block at step 3 cuts steps >= 3.
    assert set(got) == {"Programador Java", "Programador Go"}
    assert got["Programador Java"]["location"] == "Celaya" and got["Programador Go"]["location"] == "Remote"
    assert got["Programador Go"]["url"] == "https://www.bumeran.com.mx/e/3"


def test_card_fields_dedup_on_absolute_url(spark):
    cards = spark.createDataFrame([
        ("computrabajo", 0, 0, "/o/1", "", "Dev", "A", "Dev A remoto", True, False),
        ("computrabajo", 0, 1, "https://mx.computrabajo.com/o/1", "", "Dev 2", "A", "remoto", True, False),
        ("computrabajo", 0, 2, "/o/2", "", "", "B", "remoto", True, False),
        ("computrabajo", 1, 0, "/o/3", "", "Ops", "C", "presencial", True, False),
    ], CARD_SCHEMA)
    got = _by_title(cf.read_card_fields(cards))
    assert set(got) == {"Dev"} and got["Dev"]["url"] == "https://mx.computrabajo.com/o/1"


def test_registry_reads_landed_files_and_skips_failed_feeds(spark, tmp_dir):
    import os

    from feedline.sources.registry import union_feeds
    os.makedirs(os.path.join(tmp_dir, "remoteok"))
    os.makedirs(os.path.join(tmp_dir, "remotive"))
    with open(os.path.join(tmp_dir, "remoteok", "page-0001.json"), "w") as f:
        json.dump([{"legal": 1}, {"position": "Dev", "company": "A", "slug": "s"}], f)
    with open(os.path.join(tmp_dir, "remotive", "page-0001.json"), "w") as f:
        json.dump({"jobs": [{"title": "Ops", "company_name": "B", "url": "https://r/1"}]}, f)
    df, failed = union_feeds(spark, tmp_dir, ["remoteok", "remotive", "himalayas"])
    got = sorted((r["source"], r["title"]) for r in df.collect())
    assert got == [("remoteok", "Dev"), ("remotive", "Ops")]
    assert list(failed) == ["himalayas"]
    seqs = {r["source"]: r["seq"] for r in df.collect()}
    assert seqs["remoteok"] < seqs["remotive"]


def test_files_of_one_date_keep_their_order_and_their_own_places(spark, tmp_dir):
    import os

    from feedline.sources.registry import union_feeds
    os.makedirs(os.path.join(tmp_dir, "remoteok"))
    os.makedirs(os.path.join(tmp_dir, "remotive"))
    for n in (1, 2, 10):
        with open(os.path.join(tmp_dir, "remoteok", f"page-20260707-{n}.json"), "w") as f:
            json.dump([{"position": f"Dev {n}", "company": "A", "slug": n if n > 1 else None}], f)
    with open(os.path.join(tmp_dir, "remotive", "a.json"), "w") as f:
        json.dump({"jobs": [{"title": "Ops", "company_name": "B", "url": "https://r/1"}]}, f)
    df, failed = union_feeds(spark, tmp_dir, ["remoteok", "remotive"])
    rows = df.orderBy("seq").collect()
    assert [r["title"] for r in rows] == ["Dev 1", "Dev 2", "Dev 10", "Ops"] and not failed
    assert len({tuple(r["seq"]) for r in rows}) == 4
    # a null or numeric slug only makes the URL odd
    assert [r["url"].rsplit("/", 1)[1] for r in rows[:3]] == ["None", "2", "10"]


def test_newest_thread_only(spark):
    old = {"id": 9, "created_at_i": 100, "children": [{"id": 1, "text": "A | Old", "created_at_i": 1}]}
    new = {"id": 3, "created_at_i": 200, "children": [{"id": 2, "text": "B | New", "created_at_i": 1}]}
    page2 = {"id": 3, "created_at_i": 200, "children": [{"id": 4, "text": "C | More", "created_at_i": 1}]}
    got = _by_title(json_feeds.read_thread_comments(_payloads(spark, old, new, page2)))
    assert set(got) == {"New", "More"}


def test_salary_that_is_no_number_rejects_the_item(spark):
    doc = {"jobs": [{"title": "A", "companyName": "X", "applicationLink": "https://a/1", "minSalary": "a lot"},
                    {"title": "B", "companyName": "X", "applicationLink": "https://a/2", "minSalary": None}]}
    rows = json_feeds.read_json_salaried(_payloads(spark, doc), with_rejects=True).collect()
    assert {r["title"]: r["reason"] for r in rows} == {"A": "malformed", "B": None}


def test_blank_card_title_is_no_title(spark):
    cards = spark.createDataFrame([("computrabajo", 0, 0, "/o/1", "", " \t\u00a0", "A", "remoto", True, False),
                                   ("computrabajo", 0, 1, "/o/1", "", "\tDev ", "A", "remoto", True, False)], CARD_SCHEMA)
    assert list(_by_title(cf.read_card_fields(cards))) == ["Dev"]


def test_blocks_of_any_feed_cut_it(spark):
    from feedline.operators.windows import cut_after_first_block
    df = spark.createDataFrame([("own-feed", 0, False), ("own-feed", 1, True), ("own-feed", 2, False), (None, 0, True), ("x", 5, False)], "feed string, step int, blocked boolean")
    assert sorted((r.feed, r.step) for r in cut_after_first_block(df).collect()) == [("own-feed", 0), ("x", 5)]


def test_local_search_reads_the_local_rows(spark, tmp_dir):
    import os

    from feedline.sources.registry import LocalSearch, union_feeds
    spark.createDataFrame([("bumeran", 0, 0, "/e/1", "Desarrollador Python\nAcme\nremoto", "", "", "", True, False),
                           ("bumeran", 1, 0, "/e/2", "Programador Java\nBeta\nCelaya", "", "", "", False, False)], CARD_SCHEMA).write.parquet(os.path.join(tmp_dir, "bumeran"))
    for search, want in ((LocalSearch(), {"Desarrollador Python": "Remote"}),
                         (LocalSearch(" Celaya ", True), {"Desarrollador Python": "Remote", "Programador Java": "Celaya"})):
        rows, _ = union_feeds(spark, tmp_dir, ["bumeran"], search)
        assert {r["title"]: r["location"] for r in rows.collect()} == want


def test_rfc2822_forms(spark):
    from email.utils import parsedate_to_datetime

    from feedline.functions.dates import rfc2822_to_ts
    texts = ["Tue, 07 Jul 2026 10:00:00 +0000 (UTC)", "Tue, 07 Jul 2026 10:00:00", "7 Jul 26 10:00:00 GMT", "Tue, 07 Jul 2026 10:00 -0530",
             "7 Jul 70 10:00:00 EST", "Tue, 07 Jul 2026 10:00:00 PDT", "Tue, 7 July 2026 10:00:00 Z", "Sun, 06 Nov 1994 08:49:37 +0130",
             "not a date", "", "31 Feb 2026 10:00:00 GMT", "tomorrow 10:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rfc2822_to_ts(F.col("t")).alias("ts"))
    for r in df.collect():
        try:
            want = parsedate_to_datetime(r["t"])
            want = want.astimezone(dt.UTC).replace(tzinfo=None) if want.tzinfo else want
        except (TypeError, ValueError):
            want = None
        assert r["ts"] == want, r["t"]


def test_numbers_that_are_none_reject_the_item(spark):
    """Texts that are numbers count, empty values are nothing, anything else makes the item malformed."""
    item = lambda n, **more: {"position": n, "company": "A", "slug": n, **more}
    doc = [item("text", epoch="1700000000", salary_min="24000"), item("none", epoch="", salary_min=0), item("null", epoch=None, salary_min=None),
           item("empty", epoch=False, salary_min=[]), item("float", epoch=1700000000.9, salary_min=1.2e4), item("negative", salary_min=-5),
           item("nan", salary_min="nan"),
           item("bad epoch", epoch="abc"), item("bad salary", salary_min="abc"), item("half", epoch="12.5"), item("far", epoch=1e18),
           item("list", salary_min=[1]), item("object", epoch={"a": 1})]
    rows = json_feeds.read_json_array(_payloads(spark, doc), with_rejects=True).collect()
    got = {r["title"]: (r["posted_at"], r["min_salary_usd_monthly"]) for r in rows if r["reason"] is None}
    at = dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got == {"text": (at, 2000.0), "none": (None, None), "null": (None, None), "empty": (None, None), "float": (at, 1000.0),
                   "negative": (None, None), "nan": (None, None)}
    assert {r["title"]: r["reason"] for r in rows if r["reason"]} == dict.fromkeys(
        ["bad epoch", "bad salary", "half", "far", "list", "object"], "malformed")


def test_responses_that_give_nothing_say_why(spark):
    rejects = lambda read, *docs: sorted((r.seq.payload[-1], r.reason) for r in read(_payloads(spark, *docs), with_rejects=True)
                                         .filter("reason is not null").collect())
    three = [("1", "not_parsable"), ("2", "empty_response"), ("3", "wrong_shape")]
    job = {"title": "Dev", "company_name": "A", "url": "https://r/1"}
    assert rejects(json_feeds.read_json_envelope, {"jobs": [job]}, "{not json", " ", [1], {"other": 1}) == three
    assert rejects(json_feeds.read_json_envelope, {"jobs": {"a": 1}}) == [("0", "wrong_shape")]
    assert rejects(json_feeds.read_json_salaried, {"jobs": []}, "<html>", "", '"text"') == three
    assert rejects(json_feeds.read_json_array, [], "[1", "\n", {"jobs": []}) == three
    assert rejects(json_feeds.read_thread_comments, {"id": 1, "created_at_i": 5, "children": []}, "{", "", [2]) == three
    assert rejects(markup_feeds.read_rss, "<rss><channel></channel></rss>", "<rss><channel>", " ", "<html><body/></html>") == three
    # without rejects they are silent
    assert json_feeds.read_json_envelope(_payloads(spark, "{not json", {"jobs": [job]})).count() == 1


def _land(root, feed, *docs):
    import os
    os.makedirs(f"{root}/{feed}", exist_ok=True)
    for i, d in enumerate(docs):
        with open(f"{root}/{feed}/{i}.json", "w") as f:
            f.write(d if isinstance(d, str) else json.dumps(d))


def test_a_feed_of_bad_responses_is_reported_with_its_rejects(spark, tmp_dir):
    from feedline.sources.registry import union_feeds
    _land(f"{tmp_dir}/land", "remotive", "{not json", " ")
    _land(f"{tmp_dir}/land", "himalayas", {"jobs": [{"title": "Dev", "companyName": "A", "guid": "https://r/1"}]}, "{")
    rows, failed = union_feeds(spark, f"{tmp_dir}/land", ("remotive", "himalayas"), quarantine=f"{tmp_dir}/bad")
    assert rows.count() == 1 and set(failed) == {"remotive"} and "1 x not_parsable" in failed["remotive"]
    bad = sorted((r["feed"], r["reason"]) for r in spark.read.parquet(f"{tmp_dir}/bad").collect())
    assert bad == [("himalayas", "not_parsable"), ("remotive", "empty_response"), ("remotive", "not_parsable")]


def test_a_feed_that_hangs_is_cancelled_and_the_others_are_all_there(spark, tmp_dir):
    import time

    import pandas as pd

    from feedline.sources import registry

    def hangs(spark, path, search):
        @F.pandas_udf("string")
        def wait(col: pd.Series) -> pd.Series:
            time.sleep(60)
            return col
        return registry.FEEDS["remotive"](spark, path, search).withColumn("title", wait("title"))

    job = lambda n: {"jobs": [{"title": n, "company_name": "A", "url": f"https://r/{n}"}]}
    _land(f"{tmp_dir}/land", "slow", job("s"))
    for feed in ("remotive", "remotive2"):
        _land(f"{tmp_dir}/land", feed, job(feed))
    before = dict(registry.FEEDS)
    try:
        registry.register_feed("slow", hangs)
        registry.register_feed("remotive2", registry.FEEDS["remotive"])
        start = time.monotonic()
        rows, failed = registry.union_feeds(spark, f"{tmp_dir}/land", ("slow", "remotive", "remotive2"), seconds=20.0)
        assert [r["title"] for r in rows.orderBy("seq").collect()] == ["remotive", "remotive2"]
        assert list(failed) == ["slow"] and failed["slow"].startswith("TimeoutError") and time.monotonic() - start < 55
        # the jobs of the feed are gone
        status = spark.sparkContext.statusTracker()
        for _ in range(50):
            if not status.getActiveStageIds():
                break
            time.sleep(0.1)
        assert not status.getActiveStageIds()
    finally:
        registry.FEEDS.clear()
        registry.FEEDS.update(before)


def test_all_feeds_stream_under_one_checkpoint(spark, tmp_dir):
    """One landing of all eleven feeds, rendered cards and board rows among them; one is broken."""
    from feedline.params import PostingParams
    from feedline.plans.state import Store
    from feedline.sources.registry import LocalSearch, stream_readers
    from feedline.streaming import flows
    card = {"step": 0, "pos": 0, "href": "/j/1", "raw": "Python Dev\nAcme\nremoto", "title": "Python Dev", "company": "Acme",
            "text": "Python Dev Acme remoto", "is_remote": True, "blocked": False}
    local = {**card, "step": 1, "href": "/j/2", "is_remote": False}
    board = {"seq": 0, "site": "linkedin", "title": "Python Dev", "company": "Board", "location": None, "job_url": "https://b/1",
             "description": None, "date_posted": "2024-01-30", "is_remote": True}
    docs = {
        "remoteok": [{"position": "Python Dev", "company": "A", "slug": "a"}], "remotive": {"jobs": [{"title": "Python Dev", "company_name": "B", "url": "https://b"}]},
        "himalayas": {"jobs": [{"title": "Python Dev", "companyName": "C", "guid": "https://c"}]}, "hackernews": "{broken",
        "wwr": "<rss><channel><item><title>D: Python Dev</title><link>https://d</link></item></channel></rss>",
        "getonboard": _card("https://e", "Python Dev", "E", True), "cybersecjobs":
            '<li class="list-group-item"><a class="stretched-link" hx-get="/hiring/jobs/1">Python Dev</a></li>',
        "bumeran": [card, local], "computrabajo": [card, local], "occ": [card, local], "jobspy": [board, {**board, "is_remote": False, "job_url": "https://b/2"}]}
    for name, doc in docs.items():
        _land(f"{tmp_dir}/land", f"feed={name}", doc)
    params = PostingParams(keywords=("python",), max_years=None, max_age_days=None, blacklist=None, allowed_languages=None, search=LocalSearch("celaya", True, "guanajuato"))
    store = Store(spark, f"{tmp_dir}/state")
    flows.postings_stream(spark, f"{tmp_dir}/land", store, params, lambda *_: True, f"{tmp_dir}/checkpoint",
                          stream_readers(spark, params.search), quarantine=f"{tmp_dir}/bad").awaitTermination()
    got = sorted((r["source"], r["is_remote"], r["location"]) for r in store.rows().collect())
    cards = [(s, remote, "Remote" if remote else "Celaya, Guanajuato") for s in ("bumeran", "computrabajo", "occ") for remote in (False, True)]
    assert got == sorted([*cards, *((s, True, "Remote") for s in ("remoteok", "remotive", "himalayas", "weworkremotely", "getonboard", "cybersecjobs")),
                          ("linkedin", True, "Remote"), ("linkedin", False, "Remote")])
    assert [(r["feed"], r["reason"]) for r in spark.read.parquet(f"{tmp_dir}/bad/run_id=0").collect()] == [("hackernews", "not_parsable")]


def test_a_local_search_keeps_local_rows(spark):
    from feedline.params import PostingParams
    from feedline.sources.registry import LocalSearch
    assert PostingParams().require_remote and not PostingParams(search=LocalSearch("celaya", True)).require_remote
    assert PostingParams(search=LocalSearch("celaya", True), require_remote=True).require_remote
    assert LocalSearch(" Celaya", True, "Guanajuato").place == "celaya, guanajuato" and LocalSearch("celaya", False).place == ""


def test_a_feed_that_goes_on_is_not_cut_off(spark, tmp_dir):
    """Two tasks after the other outlast the limit together, each by itself does not."""
    import time

    import pandas as pd

    from feedline.sources import registry

    def slow(spark, path, search):
        @F.pandas_udf("string")
        def wait(col: pd.Series) -> pd.Series:
            time.sleep(6)
            return col
        rows = registry.FEEDS["remotive"](spark, path, search)
        for k in range(3):  # a shuffle each, so that stages follow each other
            rows = rows.withColumn("title", wait("title")).repartition(1, "title", F.lit(k))
        return rows

    _land(f"{tmp_dir}/land", "slow", {"jobs": [{"title": "s", "company_name": "A", "url": "https://r/s"}]})
    before = dict(registry.FEEDS)
    try:
        registry.register_feed("slow", slow)
        rows, failed = registry.union_feeds(spark, f"{tmp_dir}/land", ("slow",), seconds=15.0)
        assert not failed and [r["title"] for r in rows.collect()] == ["s"]
    finally:
        registry.FEEDS.clear()
        registry.FEEDS.update(before)


def test_landed_pages_are_named_in_their_order_without_a_folder_each(spark, tmp_dir):
    import os

    from feedline.sources import payloads
    from feedline.sources.registry import landed_payloads
    from feedline.schema import natural_key
    pages = spark.range(230).repartition(7).select(F.col("id").alias("payload_id"), F.concat(F.lit("p"), F.col("id")).alias("payload"))
    both = pages.withColumn("thread", F.lit("1")).unionByName(pages.select("payload_id", F.concat("payload", F.lit("a")).alias("payload"), F.lit("0").alias("thread")))
    payloads.land_pages(both, f"{tmp_dir}/land/x", "payload_id", "thread")
    got = [r["payload"] for r in landed_payloads(spark, f"{tmp_dir}/land/x").orderBy(natural_key(F.col("payload_id"))).collect()]
    assert got == [f"p{i}{t}\n" for i in range(230) for t in ("a", "")]
    assert sum(len(d) for _, d, _ in os.walk(f"{tmp_dir}/land/x")) == 5


def test_packed_responses_stream_like_a_file_each(spark, tmp_dir):
    """The same responses as files and as rows of one file: the last one in natural order gives the values of a key that comes twice."""
    import os

    from feedline.params import PostingParams
    from feedline.plans.state import Store
    from feedline.streaming import flows
    params = PostingParams(keywords=("dev",), max_years=None, max_age_days=None, blacklist=None, allowed_languages=None)
    job = lambda d: {"jobs": [{"title": "Dev", "company_name": "A", "url": "https://a", "description": d}]}
    docs = [("remotive", f"p-{n}", json.dumps(job(f"text {n}"))) for n in (10, 2)] + [("remoteok", "p-1", "{broken")]
    got = {}
    for packed in (False, True):
        root = f"{tmp_dir}/{packed}"
        for feed, page, text in docs:
            os.makedirs(f"{root}/land/feed={feed}", exist_ok=True)
            with open(f"{root}/land/feed={feed}/{page}", "w") as f:
                f.write(text)
        if packed:
            spark.createDataFrame(docs, "feed string, payload_id string, payload string").coalesce(1).write.partitionBy("feed").parquet(f"{root}/packed")
        store = Store(spark, f"{root}/state")
        flows.postings_stream(spark, f"{root}/packed" if packed else f"{root}/land", store, params, lambda *_: True, f"{root}/checkpoint",
                              quarantine=f"{root}/bad", packed=packed).awaitTermination()
        got[packed] = ([tuple(r) for r in store.rows().select("title", "description", "seq", "source").collect()],
                       [tuple(r) for r in spark.read.parquet(f"{root}/bad").select("feed", "reason").collect()])
    assert got[True] == got[False] and got[True][0][0][1] == "text 10" and got[True][1] == [("remoteok", "not_parsable", )]


def test_landed_responses_are_packed_and_leave_with_their_union(spark, tmp_dir, monkeypatch):
    import os

    from feedline.plans import q_feeds
    from feedline.sources import payloads
    from feedline.sources.registry import landed_payloads

    texts = [f"response {i} " * 400 + "é\n\n" for i in range(3)]
    payloads.land_pages(spark.createDataFrame(list(enumerate(texts)), "payload_id long, payload string"), f"{tmp_dir}/x", "payload_id")
    assert sorted(r["payload"].rstrip("\n") for r in landed_payloads(spark, f"{tmp_dir}/x").collect()) == [t.rstrip("\n") for t in texts]
    files = [os.path.join(d, f) for d, _, fs in os.walk(f"{tmp_dir}/x") for f in fs if f.startswith("part-")]
    assert len(files) == 3 and sum(map(os.path.getsize, files)) < sum(map(len, texts)) / 4

    monkeypatch.setattr(q_feeds, "checkpoint_path", lambda spark, name: f"{tmp_dir}/{name}")
    rows = q_feeds.q_union_feeds(spark, "/root/testdata/sf0.001")
    assert not os.path.exists(f"{tmp_dir}/union") and rows.count() > 0
