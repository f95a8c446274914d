"""Derived views over the driver tables (FIXTURES.md part B).

The driver tables carry no job data, so the posting, lead and crawl shapes
are derived from them by rule.  Every view is a plain DataFrame plan over the
whole tables (joins on keys, no collects), so it scales with the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from .tables import spread, table

# Fixed values used by the derived views and their oracle twins.
AS_OF = dt.datetime(2024, 1, 31)
FIXTURE_KEYWORDS = ("widget", "schkeit")
FIXTURE_MAX_AGE_DAYS = 20
FIXTURE_MIN_SALARY = 20000.0
FIXTURE_MAX_YEARS = 3
CENTRE = (20.1, -100.8)
RADIUS_KM = 80.0
CRAWL_PATHS = ("", "/contacto", "/trabaja-con-nosotros", "/bolsa-de-trabajo", "/careers", "/rh")
#: Crawl sites per block of pages: each block of 540 pages holds six paths of 90 sites of its own.
SITES_PER_BLOCK = 90


def _mod(c, n):
    return F.col(c) % F.lit(n)


def postings(spark: SparkSession, base: str) -> DataFrame:
    """B1: one posting per document; every tenth row copies an earlier one."""
    docs = spread(table(spark, base, "documents").select("doc_id", "text", "lang"))
    k = F.when(_mod("doc_id", 10) == 9, F.col("doc_id") - 9).otherwise(F.col("doc_id"))
    docs = docs.withColumn("k", k)
    part = table(spark, base, "part").select(F.col("p_partkey").alias("k"), "p_name")
    cust = table(spark, base, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    ev = (table(spark, base, "events").filter(_mod("event_id", 5) == 0)
          .select((F.col("event_id") / 5).cast("bigint").alias("doc_id"), "ts"))
    orders = table(spark, base, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice")

    j = (docs.join(part, "k", "left")
         .join(cust, "k", "left")
         .join(ev, "doc_id", "left")
         .join(orders, "doc_id", "left"))

    d = F.col("doc_id")
    kk = F.col("k")
    prefix = (F.when(kk % 7 == 0, "Senior ").when(kk % 7 == 1, "Junior ")
              .when(kk % 7 == 2, "Sr. ").when(kk % 7 == 3, "Líder ").otherwise(""))
    title0 = F.concat(prefix, F.col("p_name"))
    title = F.when(d % 10 == 9, F.upper(title0)).otherwise(title0)
    scheme = F.when(d % 17 == 16, "ftp").otherwise("https")
    url = F.concat(scheme, F.lit("://x.example/"), kk.cast("string"))
    source = (F.when(d % 4 == 0, "remoteok").when(d % 4 == 1, "himalayas")
              .when(d % 4 == 2, "hackernews").otherwise("retired_board"))
    is_remote = d % 5 != 0
    suffix = (F.when(d % 11 == 0, " 3-5 years").when(d % 11 == 1, " 7+ years")
              .when(d % 11 == 2, " 2 años").when(d % 11 == 3, " entry level")
              .when(d % 11 == 4, " 2—4 yrs").when(d % 11 == 5, " security clearance")
              .otherwise(""))
    out = j.select(
        d.alias("seq"),
        ((d / 15).cast("bigint") % 2).alias("run_no"),
        title.alias("title"),
        F.coalesce(F.col("c_name"), F.concat(F.lit("Company "), kk.cast("string"))).alias("company"),
        F.when(is_remote, "Remote").otherwise("On-site").alias("location"),
        url.alias("url"),
        source.alias("source"),
        is_remote.alias("is_remote"),
        F.col("lang"),
        F.concat(F.col("text"), suffix).alias("description"),
        F.when(d % 6 == 0, F.lit(None)).otherwise(F.col("ts")).cast("timestamp_ntz").alias("posted_at"),
        F.when(d % 3 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / 12)
        .cast("double").alias("min_salary_usd_monthly"),
    )
    return out.withColumn("fingerprint", fingerprint())


def site_host(site: F.Column) -> F.Column:
    return F.concat(F.lit("https://lead"), site.cast("string"), F.lit(".example"))


def site_path(site: F.Column) -> F.Column:
    """Every eighth site lives under a path of its host."""
    return F.when(site % 8 == 5, "/es").otherwise("")


def site_url(site: F.Column) -> F.Column:
    return F.concat(site_host(site), site_path(site))


def geo_elements(spark: SparkSession, base: str) -> DataFrame:
    """B2: OSM-like elements; even keys are nodes with lat/lon, odd keys ways with a centre.

    One site per supplier, but every tenth names an earlier one's.
    """
    s = table(spark, base, "supplier").select("s_suppkey")
    key = F.col("s_suppkey")
    site = F.when(key % 10 == 9, key - 9).otherwise(key)
    lat = F.lit(19.1) + (key % 40).cast("double") * F.lit(0.05)
    lon = F.lit(-101.8) + (key % 25).cast("double") * F.lit(0.08)
    even = key % 2 == 0
    return s.select(
        key.alias("element_id"),
        F.when(even, "node").otherwise("way").alias("type"),
        F.concat(F.lit("Lead "), site.cast("string")).alias("name"),
        F.when(key % 13 == 12, F.lit(None)).otherwise(site_url(site)).alias("website"),
        F.when(even, lat).alias("lat"),
        F.when(even, lon).alias("lon"),
        F.when(~even, lat).alias("center_lat"),
        F.when(~even, lon).alias("center_lon"),
    )


def _fragment(pid):
    p = pid.cast("string")
    generic = F.concat(F.lit('<p>Contacto: <a href="mailto:info'), p,
                       F.lit('@lead.example">Escríbenos</a></p>'))
    hr = F.concat(F.lit('<p>Ventas: <a href="mailto:ventas'), p,
                  F.lit('@lead.example?subject=Hola">ventas</a></p>'
                        '<p>Recursos Humanos: <a href="mailto:rh'), p,
                  F.lit('@lead.example">escribir</a></p>'))
    return F.when(pid % 4 == 0, generic).when(pid % 4 == 1, hr).otherwise(F.lit(""))


def page_site(pid: F.Column) -> F.Column:
    return (pid / (SITES_PER_BLOCK * len(CRAWL_PATHS))).cast("bigint") * SITES_PER_BLOCK + pid % SITES_PER_BLOCK


def crawl_pages(spark: SparkSession, base: str) -> DataFrame:
    """Crawled pages keyed by (website, path_ord, page_id) with a status code; sites grow with the pages."""
    pg = spread(table(spark, base, "pages").select("page_id", "html"))
    pid = F.col("page_id")
    paths = F.array(*[F.lit(p) for p in CRAWL_PATHS])
    path_ord = (pid / SITES_PER_BLOCK).cast("bigint") % len(CRAWL_PATHS)
    return pg.select(
        pid,
        site_url(page_site(pid)).alias("website"),
        path_ord.alias("path_ord"),
        F.element_at(paths, (path_ord + 1).cast("int")).alias("path"),
        F.when(pid % 19 == 18, 404).otherwise(200).alias("status"),
        F.concat(F.col("html"), _fragment(pid)).alias("html"),
    )


def robots_rules(spark: SparkSession, base: str) -> DataFrame:
    """The hosts of every seventh crawl site disallow that site's '/contacto' (with the site's own path)."""
    site = page_site(F.col("page_id"))
    pg = table(spark, base, "pages").select(site.alias("site")).filter(F.col("site") % 7 == 3).distinct()
    s = F.col("site")
    return pg.select(site_host(s).alias("website"), F.lit(0).cast("bigint").alias("ord"), F.lit("*").alias("agent"),
                     F.lit(False).alias("allow"), F.concat(site_path(s), F.lit("/contacto")).alias("prefix"))
