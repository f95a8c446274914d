"""Registered queries for the leads flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import explode_mailto
from ..operators import digest as dg
from ..operators.contacts import with_hr_flag
from ..operators.joins import radius_join
from ..params import DEFAULT_CONTACT_PATHS, paths_list
from ..sources import crawl, fixtures as fx, json_feeds, payloads
from ..sources.tables import table
from . import leads_flow as lf
from .registry import packed, register
from .state import marks, pending_leads

PATHS = tuple(paths_list(DEFAULT_CONTACT_PATHS))
LAT, LON = fx.CENTRE
LEAD_DIGEST = 30
CAP = 5


def _leads(spark, base):
    return json_feeds.read_geo_elements(payloads.geo_payloads(fx.geo_elements(spark, base)))


def _rules(spark, base):
    return crawl.robots_rules(crawl.robots_bodies(fx.robots_rules(spark, base)))


def _found(spark, base):
    return lf.discover(_leads(spark, base), LAT, LON, fx.RADIUS_KM)


@register("geo_radius")
def q_geo_radius(spark, base):
    return packed(_found(spark, base)).select("seq", "name", "website", F.round("distance_km", 6).alias("distance_km"))


#: Centres near 180 degrees, at latitude 70 and by the pole.
CENTRES = ((0, 20.1, -100.8), (1, 70.0, 10.0), (2, 10.0, 179.9), (3, -10.0, -179.5), (4, 89.0, 0.0))


@register("radius_join")
def q_radius_join(spark, base):
    """J7 with many centres over points spread round the globe, one per customer."""
    key = F.col("c_custkey")
    points = table(spark, base, "customer").select(
        key.alias("point_id"), ((key * 7919) % 180001 / F.lit(1000.0) - F.lit(90.0)).alias("latitude"),
        ((key * 104729) % 360001 / F.lit(1000.0) - F.lit(180.0)).alias("longitude"))
    centres = spark.createDataFrame(list(CENTRES), "centre_id long, centre_lat double, centre_lon double")
    return radius_join(points, centres, 800.0).select("centre_id", "point_id", F.round("distance_km", 6).alias("distance_km"))


@register("discovery_cap")
def q_discovery_cap(spark, base):
    return packed(lf.discovery_cap(_found(spark, base), CAP)).select("seq", "name", "website")


@register("union_geo_types")
def q_union_geo_types(spark, base):
    """U4: nodes (own coordinates) and ways (centre) read separately, then unioned."""
    e = fx.geo_elements(spark, base).filter(F.col("website").isNotNull())
    nodes = e.filter(F.col("type") == "node").select("element_id", "type", F.col("lat").alias("latitude"),
                                                     F.col("lon").alias("longitude"))
    ways = e.filter(F.col("type") == "way").select("element_id", "type", F.col("center_lat").alias("latitude"),
                                                   F.col("center_lon").alias("longitude"))
    return nodes.unionByName(ways)


@register("site_pages")
def q_site_pages(spark, base):
    from ..operators.joins import site_pages
    leads = _found(spark, base).select("website").distinct()
    return site_pages(leads, fx.crawl_pages(spark, base), PATHS).select(
        "website", "path_ord", "path", "page_id", "status")


@register("src_pages")
def q_src_pages(spark, base):
    return crawl.readable_pages(fx.crawl_pages(spark, base)).select("page_id", "website", "path_ord", "status")


@register("robots_anti")
def q_robots_anti(spark, base):
    pages = crawl.readable_pages(fx.crawl_pages(spark, base))
    from ..operators.joins import robots_allowed
    return robots_allowed(pages, _rules(spark, base)).select("page_id", "website", "path")


@register("src_robots")
def q_src_robots(spark, base):
    return _rules(spark, base)


@register("mailto_candidates")
def q_mailto_candidates(spark, base):
    pages = crawl.readable_pages(fx.crawl_pages(spark, base))
    return with_hr_flag(explode_mailto(pages.select("page_id", "html")))


@register("hr_context")
def q_hr_context(spark, base):
    return q_mailto_candidates(spark, base).groupBy("is_hr").agg(F.count(F.lit(1)).alias("n"))


@register("best_email")
def q_best_email(spark, base):
    targets = lf.crawl_targets(_found(spark, base), fx.crawl_pages(spark, base), _rules(spark, base), PATHS)
    return lf.contacts(targets)


def _new_leads(spark, base):
    return lf.leads_batch(_leads(spark, base), fx.crawl_pages(spark, base), _rules(spark, base), PATHS,
                          LAT, LON, fx.RADIUS_KM)


@register("new_leads")
def q_new_leads(spark, base):
    return packed(_new_leads(spark, base)).select("seq", "name", "website", "latitude", "longitude", "email",
                                          "email_is_hr_context", "status", "fingerprint")


@register("scan_unnotified_leads")
def q_scan_unnotified_leads(spark, base):
    """After a run that announced the first three leads with an e-mail, the rest stay pending."""
    saved = _new_leads(spark, base).checkpoint()  # one crawl for the saved rows and the announced ones
    notifiable = saved.filter(F.col("email").isNotNull())
    notes = marks(notifiable, 3, 0, "new")
    return pending_leads(saved, notes).select("fingerprint", "name", "email")


@register("lead_digest_text")
def q_lead_digest_text(spark, base):
    notifiable = _new_leads(spark, base).filter(F.col("email").isNotNull()).checkpoint()
    return dg.digest_text(notifiable, LEAD_DIGEST, dg.lead_line(), dg.LEAD_HEADER)
