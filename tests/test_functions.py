import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from feedline.functions import dates, experience, salary, text
from feedline.functions.fingerprint import fingerprint, lead_fingerprint


def _eval(spark, col, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_fingerprint_matches_python_sha256_and_has_no_separator(spark):
    df = spark.createDataFrame([("ab", "c", "https://u"), ("a", "bc", "https://u"), ("AB", "C", "HTTPS://U")],
                               "title string, company string, url string")
    got = [r[0] for r in df.select(fingerprint()).collect()]
    want = hashlib.sha256("abchttps://u".encode()).hexdigest()
    assert got == [want, want, want]


def test_fingerprint_is_field_sensitive(spark):
    df = spark.createDataFrame([("Dev", "Acme", "https://a"), ("Dev", "Acme", "https://b")],
                               "title string, company string, url string")
    a, b = [r[0] for r in df.select(fingerprint()).collect()]
    assert a != b and len(a) == 64


def test_lead_fingerprint(spark):
    df = spark.createDataFrame([("Café Uno", "https://Cafe.example")], "name string, website string")
    assert df.select(lead_fingerprint()).first()[0] == hashlib.sha256(
        "café unohttps://cafe.example".encode()).hexdigest()


@pytest.mark.parametrize("raw,expected", [
    ("Nuevo\nPublicado hace 2 días\nDesarrollador Python\nEmpresa X\nCelaya", ("Desarrollador Python", "Empresa X")),
    ("  Backend Engineer  \n\n  Acme  ", ("Backend Engineer", "Acme")),
    ("Hoy\nProgramador Senior", ("Programador Senior", "")),
    ("Nuevo\nHoy\n", ("", "")),
])
def test_title_company_lines(spark, raw, expected):
    r = _eval(spark, text.title_company_lines(F.col("x")), [raw])[0]
    assert (r["title"], r["company"]) == expected


@pytest.mark.parametrize("raw,expected", [
    ("Acme | Backend Engineer | Remote | $100k", ("Backend Engineer", "Acme")),
    ("Acme | Engineer\nsecond | line", ("Engineer", "Acme")),
    ("Just a sentence", ("Just a sentence", "")),
])
def test_title_company_pipes(spark, raw, expected):
    r = _eval(spark, text.title_company_pipes(F.col("x")), [raw])[0]
    assert (r["title"], r["company"]) == expected


@pytest.mark.parametrize("raw,expected", [
    ("Programming: Senior Dev at Acme", ("Senior Dev", "Acme")),
    ("Dev at Night at Acme Corp", ("Dev at Night", "Acme Corp")),
    ("Design: Only a title", ("Only a title", "")),
    ("A: B: C at D", ("B: C", "D")),
])
def test_title_company_at_splits_at_last_at(spark, raw, expected):
    r = _eval(spark, text.title_company_at(F.col("x")), [raw])[0]
    assert (r["title"], r["company"]) == expected


def test_slugify_keeps_unicode_letters(spark):
    got = _eval(spark, text.slugify(F.col("x")), ["Seguridad Informática!", "  C++ dev  ", "node.js"])
    assert got == ["seguridad-informática", "c-dev", "nodejs"]


def test_title_case_place_follows_python_title(spark):
    df = spark.createDataFrame([("o'higgins", "santiago"), ("san luis potosí", "  "), ("", "")],
                               "c string, s string")
    got = [r[0] for r in df.select(text.title_case_place(F.col("c"), F.col("s"))).collect()]
    assert got == ["O'Higgins, Santiago", "San Luis Potosí", ""]
    assert got[0] == ", ".join(p.strip().title() for p in ("o'higgins", "santiago"))


def test_absolutise_variants(spark):
    got = _eval(spark, text.absolutise_unless_http(F.col("x"), "https://b"), ["/a", "https://x/a", "rel"])
    assert got == ["https://b/a", "https://x/a", "https://brel"]
    got = _eval(spark, text.absolutise_if_rooted(F.col("x"), "https://b"), ["/a", "https://x/a", "rel"])
    assert got == ["https://b/a", "https://x/a", "rel"]


def test_language_window_strips_and_counts_code_points(spark):
    df = spark.createDataFrame([("  Título", "é" * 600)], "title string, description string")
    w = df.select(text.language_window()).first()[0]
    assert w.startswith("Título ") and len(w) == 500


def test_mailto_address(spark):
    got = _eval(spark, text.mailto_address(F.col("x")),
                ["mailto:a@b.c", "MAILTO: a@b.c ?subject=x", "mailto:?x", "https://a", "mailto:a@b.c?cc=d"])
    assert got == ["a@b.c", "a@b.c", None, None, "a@b.c"]


def test_hr_context_is_substring_based(spark):
    got = _eval(spark, text.hr_context(F.col("x")), ["recursos humanos:", "three apples", "ventas"])
    assert got == [True, True, False]  # "hr" inside "three" counts


@pytest.mark.parametrize("t,expected", [
    ("Need 3-5 years of experience", 3),
    ("5+ years", 5),
    ("mentor junior staff, 7 years", 0),
    ("2 years with Python and 3–6 years overall", 3),
    ("4—8 yrs", 4), ("4−8 años", 4), ("4‒8 years", 4),
    ("5 AÑOS de experiencia", 5),
    ("Entry-level role", 0), ("entry level", 0), ("sin experiencia", 0),
    ("no numbers here", None),
    ("99999999999999999999999 years", 9223372036854775807),
])
def test_min_years(spark, t, expected):
    assert _eval(spark, experience.min_years(F.col("x")), [t])[0] == expected


@pytest.mark.parametrize("title,expected", [
    ("Senior Backend Engineer", True), ("Sr. Developer", True), ("Sr Dev", True), ("Líder técnico", True),
    ("LÍDER de proyecto", True), ("Head of Security", True), ("Arquitecta de software", True),
    ("Seniority analyst", False), ("Backend Engineer", False), ("Leader", False),
])
def test_title_is_senior(spark, title, expected):
    assert _eval(spark, experience.title_is_senior(F.col("x")), [title])[0] is expected


def test_required_years_senior_implies_five_but_explicit_years_win(spark):
    df = spark.createDataFrame([("Senior Dev", ""), ("Senior Dev", "2 years"), ("Dev", "")],
                               "title string, description string")
    assert [r[0] for r in df.select(experience.required_years()).collect()] == [5, 2, None]


def test_epoch_to_ts(spark):
    got = _eval(spark, dates.epoch_to_ts(F.col("x")), [0, None, 1700000000], "x bigint")
    assert got == [None, None, dt.datetime(2023, 11, 14, 22, 13, 20)]


def test_rfc2822_to_ts(spark):
    got = _eval(spark, dates.rfc2822_to_ts(F.col("x")),
                ["Tue, 07 Jul 2026 10:00:00 +0000", "07 Jul 2026 10:00:00 GMT",
                 "Mon, 6 Jul 2026 10:00:00 -0500", "Tue, 07 Jul 2026 10:00 +0100", "yesterday", None])
    assert got == [dt.datetime(2026, 7, 7, 10), dt.datetime(2026, 7, 7, 10), dt.datetime(2026, 7, 6, 15),
                   dt.datetime(2026, 7, 7, 9), None, None]


def test_date_to_ts(spark):
    got = _eval(spark, dates.date_to_ts(F.col("x")), ["2024-01-05", "n/a", None])
    assert got == [dt.datetime(2024, 1, 5), None, None]


def test_salary_rules(spark):
    df = spark.createDataFrame([("USD", 120000.0, "annual"), ("USD", 5000.0, "monthly"), ("USD", 0.0, "monthly"),
                                ("EUR", 5000.0, "monthly"), ("USD", 50.0, "hourly"), ("USD", None, "annual")],
                               "c string, a double, p string")
    got = [r[0] for r in df.select(salary.salary_by_period(F.col("c"), F.col("a"), F.col("p"))).collect()]
    assert got == [10000.0, 5000.0, 0.0, None, None, None]
    got = _eval(spark, salary.salary_annual(F.col("x")), [120000.0, 0.0, -5.0, None], "x double")
    assert got == [10000.0, None, None, None]


def test_texts_are_python_objects_by_slices_only():
    """What a worker makes of a batch is bounded by bytes, whatever the rows of the batch."""
    import tracemalloc

    import pyarrow as pa

    from feedline.functions.arrow import map_texts, slices, small
    from feedline.functions.html import plain_text
    col = pa.array([None, "", *(f"<p>{i} {'x' * 2000}</p>" for i in range(10_000)), "y" * 3_000_000])
    cuts = list(slices(col))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1] == (len(col) - 1, len(col))
    assert max(b - a for a, b in cuts) < 600
    tracemalloc.start()
    got = list(map_texts(iter([col, col.slice(0, 0)]), plain_text, pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000  # the texts as strings and what is made of them are twice 20 MB
    assert [len(g) for g in got] == [len(col), 0] and got[0][:3].to_pylist() == [None, "", "0 " + "x" * 2000]
    back = pa.Table.from_batches(small(iter([pa.record_batch({"t": col})]), "t"))
    assert back.column("t").to_pylist() == col.to_pylist()


def test_profile_counts_equal_a_plain_count(spark):
    import collections
    import math

    from feedline.operators.language import fit_profile
    texts = [("en", "the cat " * 50), ("es", "el gato ñandú " * 40), ("en", None), ("es", ""), (None, "lost"), *[("en" if i % 2 else "es", f"word {'ab' * (i % 9)}") for i in range(300)]]
    p = fit_profile(spark.createDataFrame(texts, "lang string, text string").repartition(3))
    want = collections.defaultdict(collections.Counter)
    for lang, t in texts:
        t = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        t = " ".join(t.split()) + " " * (t.endswith(" "))
        for n in (1, 2, 3):
            want[lang].update(t[i:i + n] for i in range(len(t) - n + 1))
    vocab = set(want["en"]) | set(want["es"])
    got = {r["gram"]: r["lp"] for r in p.table.collect()}
    assert set(got) == vocab and p.rows == len(vocab)
    for i, lang in enumerate(p.langs):
        total = sum(want[lang].values()) + len(vocab)
        assert all(math.isclose(got[g][i], math.log((want[lang][g] + 1) / total), rel_tol=1e-12) for g in vocab)
