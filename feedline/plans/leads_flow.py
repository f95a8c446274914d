"""The leads flow as one DataFrame plan.

geo elements (S12) -> within radius (J7) -> one row per lead fingerprint (A1)
-> not already in the leads history (J1/J2; anti-joined *before* crawling,
which leaves the saved table unchanged because saving is insert-or-ignore)
-> lead x contact paths x crawled pages (J9) -> readable (S13) -> robots
(J5) -> mailto candidates (X3, P26) -> HR flag (P25) -> best contact (A3)
-> status (P28).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.fingerprint import lead_fingerprint
from ..functions.html import explode_mailto
from ..operators.contacts import attach_contacts, best_contact, with_hr_flag
from ..operators.dedup import dedup_last_value_first_position
from ..operators.digest import digest_slice
from ..operators.joins import new_rows, robots_allowed, site_pages, within_radius
from ..params import LeadParams
from ..sources.crawl import readable_pages
from ..sources.json_feeds import read_geo_elements
from .state import RunReport, Send, Store


def discover(leads: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """J7 + P2: leads inside the radius, with their fingerprint."""
    return within_radius(leads, lat, lon, radius_km).withColumn(
        "fingerprint", lead_fingerprint("name", "website"))


def discovery_cap(leads: DataFrame, n: int) -> DataFrame:
    """At most ``n`` leads per run, in discovery order."""
    return digest_slice(leads, n)


def crawl_targets(leads: DataFrame, pages: DataFrame, rules: DataFrame, paths) -> DataFrame:
    """J9 -> S13 -> J5: the pages we may read for each lead's site, with their path order."""
    sp = site_pages(leads.select("website").distinct(), pages, paths)
    return robots_allowed(readable_pages(sp), rules)


def contacts(targets: DataFrame) -> DataFrame:
    """X3 -> P25 -> A3: best contact per site."""
    return best_contact(with_hr_flag(explode_mailto(targets, keep=("website", "path_ord"))))


def leads_batch(leads: DataFrame, pages: DataFrame, rules: DataFrame, paths,
                lat: float, lon: float, radius_km: float, history: DataFrame | None = None,
                max_per_run: int | None = None, unseen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The whole flow up to the rows to save (LEAD columns + fingerprint + distance).

    ``max_per_run`` (W2) is the discovery cap: the first leads found, before
    those known already are taken off, like the reference's request limit.
    ``history`` or ``unseen`` takes off the known leads: a table of them, or a
    function that returns what a store has not saved.
    """
    found = discover(leads, lat, lon, radius_km)
    if max_per_run is not None:
        found = discovery_cap(found, max_per_run)
    found = dedup_last_value_first_position(found, "fingerprint")
    if history is not None:
        found = new_rows(found, history, "fingerprint")
    if unseen is not None:
        found = unseen(found)
    return attach_contacts(found, contacts(crawl_targets(found, pages, rules, paths)))


def run_leads(spark: SparkSession, payloads: DataFrame, pages: DataFrame, rules: DataFrame, store: Store, run_id: int,
              params: LeadParams, send: Send) -> RunReport:
    """One batch run over landed geo payloads: S12 -> W2 -> the flow -> ``Store.run``."""
    rows = leads_batch(read_geo_elements(payloads), pages, rules, params.contact_paths, params.lat, params.lon, params.radius_km,
                       max_per_run=params.max_per_run, unseen=lambda found: store.unseen(found, run_id))
    return store.run(rows.drop("distance_km", "type"), run_id, params.digest_size, send)
