"""Readers over landed JSON payloads.

Input: a table ``(payload_id bigint, payload string)`` -- one fetched response
per row (``spark.read.text(path, wholetext=True)`` gives the same shape for
files).  Payloads are parsed once with ``parse_json`` into VARIANT, which
keeps "missing key" (SQL NULL) apart from "explicit null"
(``is_variant_null``): a missing key takes the feed's default, an explicit
null makes the item malformed, and malformed items are dropped (or routed to
quarantine, F14) without failing the feed.

``seq`` is the item's PLACE: its payload in fetch order, then its position
inside it, i.e. the order in which the reference would have listed the items.
With ``with_rejects`` a reader returns its malformed items too, each with the
``reason`` for the quarantine table (F14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_to_ts, rfc2822_to_ts
from ..functions.html import html_to_text
from ..functions.salary import salary_annual, salary_by_period
from ..functions.text import remote_flag, strip, title_company_pipes
from ..operators.predicates import EMPTY, NOT_PARSABLE, WRONG_SHAPE, finish
from ..schema import place

# URL shapes the feeds build from item fields.
REMOTEOK_JOB_URL = "https://remoteok.com/remote-jobs/"
HN_ITEM_URL = "https://news.ycombinator.com/item?id="


def _items(payloads: DataFrame, path: str) -> DataFrame:
    """Explode the array at ``path`` of every payload into (seq, item variant, ``bad``).

    A response that is empty, does not parse or has another shape gives one row
    without an item whose ``bad`` says so, in the same scan.  A list that is
    missing from an object is no fault: it holds nothing.
    """
    text = F.coalesce(F.col("payload"), F.lit(""))
    v = payloads.select("payload_id", (strip(text) == "").alias("blank"), F.try_parse_json("payload").alias("v"))
    arr = F.try_variant_get("v", path, "array<variant>")
    top = F.schema_of_variant("v")
    at = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    if path == "$":
        shaped = top.startswith("ARRAY")
    else:
        shaped = top.startswith("OBJECT") & F.coalesce(at.startswith("ARRAY"), F.lit(True))
    bad = (F.when(F.col("blank"), F.lit(EMPTY)).when(F.col("v").isNull(), F.lit(NOT_PARSABLE))
           .when(~F.coalesce(shaped, F.lit(False)), F.lit(WRONG_SHAPE)))
    nothing = F.array(F.lit(None).cast("variant"))
    return (v.select("payload_id", bad.alias("bad"), arr.alias("arr"))
            .select("payload_id", "bad", F.posexplode(F.when(F.col("bad").isNotNull(), nothing).otherwise(F.col("arr"))).alias("pos", "item"))
            .select(place(F.col("payload_id"), F.col("pos")).alias("seq"), "item", "bad"))


def _raw(item: Column, key: str) -> Column:
    return F.variant_get(item, f"$.{key}", "variant")


def _is_type(item: Column, key: str, *types: str) -> Column:
    return F.schema_of_variant(_raw(item, key)).isin(list(types))


def str_field(item: Column, key: str, default: str | None = "") -> tuple[Column, Column]:
    """(value, ok): missing -> default, string -> value, explicit null or other type -> not ok."""
    missing = _raw(item, key).isNull()
    is_str = F.coalesce(_is_type(item, key, "STRING"), F.lit(False))
    value = F.when(missing, F.lit(default)).when(is_str, F.variant_get(item, f"$.{key}", "string"))
    ok = (missing & F.lit(default is not None)) | is_str
    return value, ok


def _num(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "double")


def number_field(item: Column, key: str, whole: bool = False) -> tuple[Column, Column]:
    """(value, ok): a number, or a text that is one; missing, null, false and empty values -> null and ok; anything else -> not ok.

    ``whole``: a text must be a whole number, and the value one that is a time between the years 1 and 9999.
    """
    raw = _raw(item, key)
    kind = F.coalesce(F.schema_of_variant(raw), F.lit("VOID"))
    text = F.trim(F.try_variant_get(item, f"$.{key}", "string"))
    shape = r"^[+-]?\d+$" if whole else r"^(?i)[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"
    value = F.when(kind == "BOOLEAN", F.nullif(_num(item, key), F.lit(0.0))).when(kind == "STRING", F.when(text.rlike(shape), text.try_cast("double"))).otherwise(_num(item, key))
    nothing = (kind == "VOID") | (F.to_json(raw).isin("", '""', "false", "[]", "{}"))
    if whole:
        value = F.when(value.between(-62135596800, 253402300799), value)
    return F.when(~nothing, value), nothing | value.isNotNull()


# ---------------------------------------------------------------- S1

def read_json_array(payloads: DataFrame, with_rejects: bool = False) -> DataFrame:
    """Top-level array; dict elements having a ``position`` key are postings."""
    it = _items(payloads, "$")
    item = F.col("item")
    it = it.filter(F.col("bad").isNotNull() | F.schema_of_variant(item).startswith("OBJECT") & _raw(item, "position").isNotNull())
    title, ok1 = str_field(item, "position")
    company, ok2 = str_field(item, "company")
    # the slug only goes into the URL, where a null or a number is written as text
    kind = F.schema_of_variant(_raw(item, "slug"))
    slug = (F.when(_raw(item, "slug").isNull(), F.lit("")).when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(item, "$.slug", "string")))
            .otherwise(F.coalesce(F.try_variant_get(item, "$.slug", "string"), F.to_json(_raw(item, "slug")))))
    desc, ok4 = str_field(item, "description")
    epoch, ok5 = number_field(item, "epoch", whole=True)
    salary, ok6 = number_field(item, "salary_min")
    out = it.select(
        "seq", "bad",
        title.alias("title"), company.alias("company"), F.lit("Remote").alias("location"),
        F.concat(F.lit(REMOTEOK_JOB_URL), slug).alias("url"),
        F.lit("remoteok").alias("source"), F.lit(True).alias("is_remote"),
        desc.alias("description"),
        epoch_to_ts(epoch.cast("bigint")).alias("posted_at"),
        salary_annual(F.when(~F.isnan(salary), salary)).alias("min_salary_usd_monthly"),
        (ok1 & ok2 & ok4 & ok5 & ok6).alias("__ok"))
    return finish(out, with_rejects)


# ---------------------------------------------------------------- S2

def read_json_envelope(payloads: DataFrame, with_rejects: bool = False) -> DataFrame:
    """Object with a ``jobs`` array (absent -> no rows); location defaults to Remote."""
    it = _items(payloads, "$.jobs")
    item = F.col("item")
    title, ok1 = str_field(item, "title")
    company, ok2 = str_field(item, "company_name")
    loc, ok3 = str_field(item, "candidate_required_location", "Remote")
    url, ok4 = str_field(item, "url")
    desc, ok5 = str_field(item, "description")
    out = it.select(
        "seq", "bad", title.alias("title"), company.alias("company"), loc.alias("location"),
        url.alias("url"), F.lit("remotive").alias("source"), F.lit(True).alias("is_remote"),
        desc.alias("description"), F.lit(None).cast("timestamp_ntz").alias("posted_at"),
        F.lit(None).cast("double").alias("min_salary_usd_monthly"),
        (ok1 & ok2 & ok3 & ok4 & ok5).alias("__ok"))
    return finish(out, with_rejects)


# ---------------------------------------------------------------- S3

def read_json_salaried(payloads: DataFrame, with_rejects: bool = False) -> DataFrame:
    """S3: ``jobs`` array with location restrictions, int-or-RFC-2822 dates and USD salary."""
    it = _items(payloads, "$.jobs")
    item = F.col("item")
    title, ok1 = str_field(item, "title")
    company, ok2 = str_field(item, "companyName")
    link = F.coalesce(F.try_variant_get(item, "$.applicationLink", "string"), F.lit(""))
    guid = F.coalesce(F.try_variant_get(item, "$.guid", "string"), F.lit(""))
    url = F.when(link != "", link).otherwise(guid)
    restrictions = F.try_variant_get(item, "$.locationRestrictions", "array<string>")
    location = F.coalesce(F.get(restrictions, 0), F.lit("Remote"))
    desc, ok3 = str_field(item, "description")
    # a salary that is there but no number makes the item malformed
    salary_t = F.schema_of_variant(_raw(item, "minSalary"))
    ok4 = _raw(item, "minSalary").isNull() | (salary_t == "VOID") | salary_t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | salary_t.startswith("DECIMAL")
    pub_t = F.schema_of_variant(_raw(item, "pubDate"))
    numeric = pub_t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | pub_t.startswith("DECIMAL")
    posted = (F.when(numeric, F.timestamp_seconds(_num(item, "pubDate")).cast("timestamp_ntz"))
               .when(pub_t == "STRING", rfc2822_to_ts(F.variant_get(item, "$.pubDate", "string"))))
    out = it.select(
        "seq", "bad", title.alias("title"), company.alias("company"), location.alias("location"),
        url.alias("url"), F.lit("himalayas").alias("source"), F.lit(True).alias("is_remote"),
        desc.alias("description"),
        posted.alias("posted_at"),
        salary_by_period(F.try_variant_get(item, "$.currency", "string"), _num(item, "minSalary"),
                         F.try_variant_get(item, "$.salaryPeriod", "string")).alias("min_salary_usd_monthly"),
        (ok1 & ok2 & ok3 & F.coalesce(ok4, F.lit(True))).alias("__ok"))
    return finish(out, with_rejects)


# ---------------------------------------------------------------- S4

def newest_thread_payloads(threads: DataFrame) -> DataFrame:
    """W4 over landed thread payloads: those of the newest thread (creation time, then id)."""
    v = F.try_parse_json("payload")
    t = threads.select("payload_id", "payload", F.struct(
        F.coalesce(F.try_variant_get(v, "$.created_at_i", "bigint"), F.lit(-1)).alias("created_at"),
        F.coalesce(F.try_variant_get(v, "$.id", "bigint"), F.lit(-1)).alias("id")).alias("__thread"))
    # a response that is no thread takes no part in the choice, and stays to be rejected
    is_thread = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    t = t.withColumn("__is_thread", is_thread)
    newest = t.filter("__is_thread").agg(F.max("__thread").alias("__newest"))  # one row
    kept = t.join(F.broadcast(newest), ~F.col("__is_thread") | (F.col("__thread") == F.col("__newest")))
    return kept.select("payload_id", "payload")


def read_thread_comments(threads: DataFrame, with_rejects: bool = False) -> DataFrame:
    """Comments (``children``) of the newest landed thread -> postings.

    Deleted (null) and empty comments are skipped; the first line of the
    plain text gives "company | title | ..."; REMOTE anywhere sets the flag.
    """
    it = _items(newest_thread_payloads(threads), "$.children")
    item = F.col("item")
    text = F.try_variant_get(item, "$.text", "string")
    it = it.filter(F.col("bad").isNotNull() | text.isNotNull() & (text != "")).select(
        "seq", "bad", F.try_variant_get(item, "$.id", "string").alias("id"),
        F.try_variant_get(item, "$.created_at_i", "bigint").alias("created"),
        text.alias("html"))
    plain = it.withColumn("plain", html_to_text(F.col("html")))
    tc = title_company_pipes(F.col("plain"))
    remote = remote_flag(F.col("plain"))
    out = plain.select(
        "seq", "bad", tc["title"].alias("title"), tc["company"].alias("company"),
        F.when(remote, "Remote").otherwise("On-site").alias("location"),
        F.concat(F.lit(HN_ITEM_URL), F.coalesce(F.col("id"), F.lit(""))).alias("url"),
        F.lit("hackernews").alias("source"), remote.alias("is_remote"),
        F.col("plain").alias("description"), epoch_to_ts(F.col("created")).alias("posted_at"),
        F.lit(None).cast("double").alias("min_salary_usd_monthly"),
        (tc["title"] != "").alias("__ok"))
    return finish(out, with_rejects)


# ---------------------------------------------------------------- S12 / U4

def read_geo_elements(payloads: DataFrame) -> DataFrame:
    """OSM elements -> leads.  name and website tags must be non-empty;
    coordinates come from the element, else from its ``center`` (nodes and ways, U4)."""
    it = _items(payloads, "$.elements")
    item = F.col("item")
    name = F.try_variant_get(item, "$.tags.name", "string")
    website = F.try_variant_get(item, "$.tags.website", "string")
    lat = F.coalesce(_num(item, "lat"), _num(item, "center.lat"))
    lon = F.coalesce(_num(item, "lon"), _num(item, "center.lon"))
    out = it.select("seq", F.try_variant_get(item, "$.type", "string").alias("type"),
                    name.alias("name"), website.alias("website"),
                    lat.alias("latitude"), lon.alias("longitude"))
    return out.filter((F.coalesce(F.length("name"), F.lit(0)) > 0)
                      & (F.coalesce(F.length("website"), F.lit(0)) > 0)
                      & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
