from feedline.functions.html import Page, anchors, explode_mailto, list_links, mail_anchors, plain_text, result_cards
from feedline.operators.contacts import best_contact, with_hr_flag
from feedline.operators.joins import radius_join, robots_allowed, within_radius
from feedline.sources.crawl import robots_rules


def _candidates(spark, *pages):
    df = spark.createDataFrame([(i, "w", h) for i, h in enumerate(pages)], "page_id long, website string, html string")
    return [tuple(r) for r in explode_mailto(df, keep=("website",)).orderBy("page_id", "pos").collect()]


def test_mailto_context_uses_parent_own_text_only(spark):
    html = ('<div>Ventas <a href="mailto:ventas@x.mx?subject=hola">escribir</a> '
            '<span>Recursos Humanos</span> <a href="MAILTO:rh@x.mx">rh</a></div>'
            '<p>Trabaja con nosotros: <a href="mailto:jobs@x.mx">aquí</a></p><a href="mailto:">empty</a><a>none</a>')
    got = _candidates(spark, html, None, "", "<p>no link")
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(0, "w", 0, "ventas@x.mx"), (0, "w", 1, "rh@x.mx"), (0, "w", 2, "jobs@x.mx")]
    # the sibling span's "Recursos Humanos" does not bleed into the first anchor's context
    assert "recursos" not in got[0][4] and got[0][4].startswith("escribir ventas")
    assert "trabaja con nosotros" in got[2][4]


def test_deep_pages_do_not_break_the_walk(spark):
    deep = "<li>" * 100_000 + '<a href="mailto:x@y.mx">z</a>'
    assert plain_text(deep) == "z" and len(anchors(Page(deep))) == 1
    assert result_cards("<b>" * 100_000) == [] and list_links("</i>" * 100_000 + "<p>" * 100_000, "/x") == []
    assert [g[3] for g in _candidates(spark, deep, '<a href="mailto:q@r.mx">s</a>')] == ["x@y.mx", "q@r.mx"]


def test_elements_left_open_cost_what_closed_ones_do():
    import time
    n = 100_000
    start = time.process_time()
    links, own = mail_anchors(Page('<a href="/x">t' * n + '<a href="mailto:a@b.mx">z</a>'))
    assert len(links) == 1 and links[0].ord == n and own == ["t"]
    links, own = mail_anchors(Page('<p>own<a href="mailto:a@b.mx">t' * n))
    assert len(links) == n and len(own) == n and links[0].size == 1 + 6 * (n - 1)
    card = '<a class="results-item" href="/j"><h4 class="results-list-title">'
    assert result_cards(card * n) == []
    assert list_links('<li class="list-group-item"><a class="stretched-link" hx-get="/other">x' * n, "/jobs/") == []
    assert time.process_time() - start < 30  # quadratic walks take minutes


def test_ranges_equal_a_walk_of_the_tree():
    """Texts and first descendants against a plain tree over random markup."""
    import random
    rng = random.Random(7)
    tags = ["a", "div", "p", "li", "br", "script", "template", "strong"]
    for _ in range(60):
        html = "".join(rng.choice([f"<{t} class='c{rng.randrange(3)} d'>", f"</{t}>", f" w{rng.randrange(50)} ", "<!-- x -->"])
                       for t in rng.choices(tags, k=60))
        page = Page(html)
        below = {n: set() for n in range(len(page.tags))}
        for n in range(1, len(page.tags)):
            up = n
            while up:
                up = page.parents[up]
                below[up].add(n)
        for n in below:
            assert below[n] == set(range(n + 1, page.last[n] + 1))
            texts = [t for t, p in zip(page.texts, page.text_parents) if p == n or p in below[n]]
            assert page.text(n) == "".join(t.strip() for t in texts)
            start, size = page.span(n)
            assert page.spaced[0][start:start + size].decode() == " ".join(t.strip() for t in texts if t.strip())
            for tag in tags:
                for cls in ("", "c1", "d"):
                    want = [m for m in sorted(below[n]) if page.tags[m] == tag and (not cls or cls in page.attrs[m].get("class", "").split())]
                    assert page.first(n, tag, cls) == (want[0] if want else None)


def test_plain_text_skips_script_and_decodes_entities():
    assert plain_text("<p>a &amp; b</p><script>var x='<p>';</script><style>p{}</style>c") == "a & bc"


def test_best_contact_prefers_hr_then_first(spark):
    cands = spark.createDataFrame([
        ("s1", 0, 10, 0, "info@s1", "contacto"), ("s1", 1, 11, 0, "rh@s1", "recursos humanos"),
        ("s1", 2, 12, 0, "jobs@s1", "careers"),
        ("s2", 0, 20, 1, "second@s2", "ventas"), ("s2", 0, 20, 0, "first@s2", "ventas"),
    ], "website string, path_ord long, page_id long, pos long, email string, context string")
    got = {r["website"]: (r["email"], r["email_is_hr_context"]) for r in best_contact(with_hr_flag(cands)).collect()}
    assert got == {"s1": ("rh@s1", True), "s2": ("first@s2", False)}


def test_robots_rules_and_anti_join(spark):
    bodies = spark.createDataFrame([
        ("https://a", 200, "User-agent: postbot\nDisallow: /rh\n\nUser-agent: *\nDisallow: /"),
        ("https://b", 200, "# c\nUser-agent: *\nAllow: /contacto/ok\nDisallow: /contacto\nDisallow:\n"),
        ("https://c", 404, "User-agent: *\nDisallow: /"),
        ("https://d", 200, "User-agent: *\nDisallow: *"),
    ], "website string, status int, body string")
    rules = robots_rules(bodies)
    got = sorted((r["website"], r["ord"], r["allow"], r["prefix"]) for r in rules.collect())
    assert got == [("https://a", 0, False, "/rh"),
                   ("https://b", 0, True, "/contacto/ok"), ("https://b", 1, False, "/contacto"),
                   ("https://b", 2, True, ""), ("https://d", 0, False, "*")]
    pages = spark.createDataFrame([
        ("https://a", "", 1), ("https://a", "/rh", 2), ("https://b", "/contacto", 3),
        ("https://b", "/contacto/ok", 4), ("https://c", "/contacto", 5), ("https://d", "", 6)],
        "website string, path string, page_id long")
    kept = sorted(r["page_id"] for r in robots_allowed(pages, rules).collect())
    assert kept == [1, 4, 5]


def test_robots_rules_hold_for_the_whole_host_and_path(spark):
    """Against the standard parser: groups, other lines, blank lines, tabs, escapes, sites with a path."""
    import urllib.robotparser
    bodies = ["User-agent: postbot\nCrawl-delay: 3\nUser-agent: badbot\nDisallow: /\n",
              "User-agent:\tpostbot\nDisallow:\t/x\n\nDisallow: /y\n", "User-agent: *\n\nDisallow: /a\n",
              "User-agent: a\nUser-agent: postbot\nDisallow: /q\nUser-agent: *\nDisallow: /\n",
              "# c\n\nUser-agent: *\n# hi\nDisallow: /z%20a\nAllow: /\n",
              "User-agent: *\nDisallow: /b\n\n\nUser-agent: postbot\nDisallow: /c\nSitemap: x\nDisallow: /d",
              "User-agent: *\nDisallow: /es/contacto\n"]
    robots = spark.createDataFrame([(f"https://h{i}.x", 200, b) for i, b in enumerate(bodies)], "website string, status int, body string")
    paths = ["", "/", "/x", "/y/1", "/a", "/q", "/z a", "/z%20a", "/b", "/c", "/d", "/contacto", "/es/contacto"]
    pages = spark.createDataFrame([(f"https://h{i}.x{s}", p) for i in range(len(bodies)) for s in ("", "/es") for p in paths], "website string, path string")
    kept = {(r.website, r.path) for r in robots_allowed(pages, robots_rules(robots)).collect()}
    for i, body in enumerate(bodies):
        std = urllib.robotparser.RobotFileParser()
        std.parse(body.splitlines())
        for s in ("", "/es"):
            for p in paths:
                assert ((f"https://h{i}.x{s}", p) in kept) == std.can_fetch("postbot/1.0", f"https://h{i}.x{s}{p}"), (i, s, p)


def _km(a, b, c, d):
    import math
    r = math.radians
    x = math.sin((r(c) - r(a)) / 2) ** 2 + math.cos(r(a)) * math.cos(r(c)) * math.sin((r(d) - r(b)) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(x))


def test_radius_finds_all_points_round_the_globe(spark):
    import random
    rng = random.Random(1)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(2000)]
    pts += [(3000 + i, rng.uniform(60, 90), rng.uniform(-180, 180)) for i in range(1500)]
    pts += [(5000 + i, rng.uniform(-20, 20), rng.choice([-1, 1]) * rng.uniform(178, 180)) for i in range(800)]
    centres = [(0, 70.0, 10.0), (1, 89.0, 0.0), (2, 0.0, 179.9), (3, 10.0, -179.5), (4, -88.0, 100.0), (5, 20.1, -100.8), (6, 90.0, 0.0)]
    points = spark.createDataFrame(pts, "id long, latitude double, longitude double")
    cs = spark.createDataFrame(centres, "centre_id long, centre_lat double, centre_lon double")
    for radius in (80.0, 500.0, 3000.0):
        want = sorted((c, i) for c, a, b in centres for i, la, lo in pts if _km(a, b, la, lo) <= radius)
        assert sorted((r.centre_id, r.id) for r in radius_join(points, cs, radius).collect()) == want
        for c, a, b in centres[:4]:
            assert sorted(r.id for r in within_radius(points, a, b, radius).collect()) == [i for k, i in want if k == c]


def test_leads_without_email_are_saved_but_never_notified_or_retried(spark, tmp_dir):
    """Trap 18: a lead without e-mail is stored (status no_email_found) but never announced."""
    import os

    from feedline.plans.state import Store
    leads = spark.createDataFrame([
        (1, "fa", "A", "https://a", 20.1, -100.8, "rh@a", True, "pending"),
        (2, "fb", "B", "https://b", 20.1, -100.8, None, False, "no_email_found"),
        (3, "fc", "C", "https://c", 20.1, -100.8, "info@c", False, "pending")],
        "seq long, fingerprint string, name string, website string, latitude double, longitude double, "
        "email string, email_is_hr_context boolean, status string")
    store = Store(spark, os.path.join(tmp_dir, "leads"), "leads", leads=True)
    announced = []

    def send(rows, *_):
        announced.append(sorted(r["fingerprint"] for r in rows.collect()))
        return False  # delivery fails: announced leads stay pending, e-mail-less ones never appear

    rep = store.run(leads, 0, 30, send)
    assert rep.inserted == 3 and announced == [["fa", "fc"]]
    assert sorted(r["fingerprint"] for r in store.pending().collect()) == ["fa", "fc"]
    rep = store.run(leads.limit(0), 1, 30, lambda *_: True)  # the retry marks them
    assert rep.retried == 2 and rep.retry_sent and store.pending().count() == 0
    assert store.rows().filter("status = 'no_email_found'").count() == 1


def test_leads_seen_before_are_not_crawled_again(spark):
    """Trap 17: anti-join with the leads history first; the new rows equal the full run minus history."""
    from feedline.params import DEFAULT_CONTACT_PATHS, paths_list
    from feedline.plans import leads_flow as lf
    from feedline.sources import crawl, fixtures as fx, json_feeds, payloads

    from .conftest import SF_SMALL
    leads = json_feeds.read_geo_elements(payloads.geo_payloads(fx.geo_elements(spark, SF_SMALL)))
    pages, rules = fx.crawl_pages(spark, SF_SMALL), crawl.robots_rules(crawl.robots_bodies(fx.robots_rules(spark, SF_SMALL)))
    args = (pages, rules, tuple(paths_list(DEFAULT_CONTACT_PATHS)), 20.1, -100.8, 80.0)
    full = {r["fingerprint"]: r for r in lf.leads_batch(leads, *args).collect()}
    assert full
    seen = sorted(full)[: max(1, len(full) // 2)]
    history = spark.createDataFrame([(f,) for f in seen], "fingerprint string")
    new = {r["fingerprint"]: r for r in lf.leads_batch(leads, *args, history=history).collect()}
    assert set(new) == set(full) - set(seen)
    assert all(new[f]["email"] == full[f]["email"] for f in new)


def test_robots_of_a_host_with_many_rules_equal_the_plain_test(spark):
    """A thousand rules and thousands of paths on one host: no path meets every rule."""
    import random

    from feedline.sources.crawl import percent_encoded, url_path
    from pyspark.sql import functions as F
    rng = random.Random(3)
    piece = lambda: "/" + "".join(rng.choice("ab%é") for _ in range(rng.randint(0, 4)))
    rules = [("https://h", n, rng.random() < 0.4, piece() + (piece() if rng.random() < 0.5 else "")) for n in range(1000)]
    rules += [("https://s", 0, True, "/ok"), ("https://s", 1, False, "*"), ("https://t", 0, True, "")]
    pages = [("https://h", piece() + piece() + piece(), i) for i in range(3000)]
    pages += [("https://h/base", "/x", 5000), ("https://s", "/ok/1", 5001), ("https://s", "/no", 5002), ("https://t", "/a", 5003), ("https://u", "/a", 5004)]
    rdf = spark.createDataFrame(rules, "website string, ord long, allow boolean, prefix string")
    pdf = spark.createDataFrame(pages, "website string, path string, page_id long")
    out = robots_allowed(pdf, rdf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    encoded = {r.p: r.e for r in rdf.select(F.col("prefix").alias("p"), percent_encoded(F.col("prefix")).alias("e")).distinct().collect()}
    path = {r.page_id: r.e for r in pdf.select("page_id", percent_encoded(url_path(F.concat("website", "path"))).alias("e")).collect()}
    own = {"https://h": [r for r in rules if r[0] == "https://h"], "https://s": rules[1000:1002], "https://t": rules[1002:]}
    want = set()
    for site, _, i in pages:
        first = next((allow for _, _, allow, p in own.get(site[:9], []) if p == "*" or path[i].startswith(encoded[p])), True)
        if first:
            want.add(i)
    assert {r.page_id for r in out.collect()} == want and 0 < len(want) < len(pages)
