"""The joins of the postings and leads flows.

History tables only grow, so no operator here ever shuffles or broadcasts
the history for a membership test when the batch is small: J1 reduces the
history to the batch's keys first (semi join with the batch's fingerprints
broadcast when provably small), and J2 anti-joins the batch with that small
result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any, searchable_text
from ..sources.crawl import percent_encoded, url_host, url_path
from .sizing import KEY_ROW_BYTES, broadcast_rows_if_bounded

EARTH_RADIUS_KM = 6371.0


# ---------------------------------------------------------------- J1 / J2

def seen_keys(history: DataFrame, batch: DataFrame, key: str = "fingerprint",
              batch_key_rows: int | None = None) -> DataFrame:
    """The batch keys already present in the history (distinct).

    The batch's key set is broadcast only if the caller counted it
    (``batch_key_rows``, e.g. after materialising the batch) and the count
    fits.  Otherwise the semi join shuffles and AQE re-plans from measured
    sizes.
    """
    side = batch.select(key).distinct()
    if batch_key_rows is not None:
        side = broadcast_rows_if_bounded(side, batch_key_rows, KEY_ROW_BYTES)
    return history.select(key).join(side, key, "left_semi").distinct()


def new_rows(batch: DataFrame, history: DataFrame, key: str = "fingerprint",
             batch_key_rows: int | None = None) -> DataFrame:
    """Batch rows whose key is not in the history (via J1's reduced key set).

    The seen set is a subset of the batch's keys, so when those were proven
    small the seen set is broadcast too.
    """
    seen = seen_keys(history, batch, key, batch_key_rows)
    if batch_key_rows is not None:
        seen = broadcast_rows_if_bounded(seen, batch_key_rows, KEY_ROW_BYTES)
    return batch.join(seen, key, "left_anti")


# ---------------------------------------------------------------- J5 robots

def robots_allowed(pages: DataFrame, rules: DataFrame, site: str = "website",
                   path: str = "path") -> DataFrame:
    """Drop (site, path) pairs that a robots rule of the site's host disallows.

    A site may have a path of its own; the robots file is its host's, and a
    rule applies when the request's whole path starts with its prefix (or the
    prefix is ``*``), both with their escapes in one form.  The first
    applicable rule (by ``ord``) decides -- plain prefix matching, no wildcards
    inside paths.

    Each distinct (site, path) gives its prefixes of the lengths that rules of
    its host have, and (host, prefix) is an equi-join with at most one rule, the
    first of those with that prefix: no path meets every rule of its host.  Page
    bodies never meet the rules; the pages are anti-joined with the denied pairs.
    """
    url = F.concat(F.regexp_replace(F.col(site), "/+$", ""), F.col(path))
    pairs = pages.select(site, path).distinct().select(
        site, path, url_host(url).alias("__host"), percent_encoded(url_path(url)).alias("__req"))
    # '*' applies to every path, like the empty prefix
    prefix = F.when(F.col("prefix") == "*", F.lit("")).otherwise(percent_encoded(F.col("prefix")))
    first = (rules.select(url_host(F.col(site)).alias("__host"), prefix.alias("__prefix"), "ord", "allow")
             .groupBy("__host", "__prefix").agg(F.min(F.struct("ord", "allow")).alias("__rule")))
    # as many lengths as the longest rule of a host has characters, at most
    lengths = first.groupBy("__host").agg(F.collect_set(F.length("__prefix")).alias("__lengths"))
    some = F.filter("__lengths", lambda n: n <= F.length("__req"))
    cut = pairs.join(lengths, "__host").select(site, path, "__host", F.explode(some).alias("__n"), "__req")
    cut = cut.select(site, path, "__host", F.expr("left(__req, __n)").alias("__prefix"))
    ruled = cut.join(first, ["__host", "__prefix"]).groupBy(site, path).agg(F.min("__rule").alias("__rule"))
    return pages.join(ruled.filter("not __rule.allow").select(site, path), [site, path], "left_anti")


# ---------------------------------------------------------------- J6 keyword theta

def keyword_semi(df: DataFrame, terms, text: Column | None = None, how: str = "left_semi") -> DataFrame:
    """Rows whose searchable text contains any term (``left_anti``: none).

    The terms are a parameter list of any length; one scan of each text tests
    them all (``contains_any``), so no row meets the terms one by one.
    """
    found = contains_any(searchable_text() if text is None else text, list(terms))
    return df.filter(found if how == "left_semi" else ~found)


# ---------------------------------------------------------------- J7 geo radius

def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    r = F.radians
    dlat = r(lat2) - r(lat1)
    dlon = r(lon2) - r(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def bbox(lat: float, lon: float, radius_km: float) -> tuple[float, float, list[tuple[float, float]]]:
    """Latitude range and longitude ranges that hold every point within the radius.

    Away from the poles the half-width is asin(sin(r/R) / cos(lat)); a circle
    that takes in a pole has every longitude; one across 180 degrees has two ranges.
    """
    ang = radius_km / EARTH_RADIUS_KM
    lo_lat, hi_lat = lat - math.degrees(ang), lat + math.degrees(ang)
    if lo_lat <= -90 or hi_lat >= 90:
        return max(lo_lat, -90.0), min(hi_lat, 90.0), [(-180.0, 180.0)]
    half = math.degrees(math.asin(min(1.0, math.sin(ang) / math.cos(math.radians(lat)))))
    lo, hi = lon - half, lon + half
    spans = [(lo, hi)]
    if lo < -180:
        spans = [(-180.0, hi), (lo + 360, 180.0)]
    elif hi > 180:
        spans = [(lo, 180.0), (-180.0, hi - 360)]
    return lo_lat, hi_lat, spans


def within_radius(points: DataFrame, lat: float, lon: float, radius_km: float,
                  lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """J7 (one centre): bounding box as plain range predicates (pushed to the scan),
    then the exact great-circle test."""
    lo_lat, hi_lat, spans = bbox(lat, lon, radius_km)
    la, lo = F.col(lat_col), F.col(lon_col)
    slack = 1e-9
    around = reduce(lambda a, b: a | b, [lo.between(w - slack, e + slack) for w, e in spans])
    boxed = points.filter(la.between(lo_lat - slack, hi_lat + slack) & around)
    return (boxed.withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lon), la, lo))
            .filter(F.col("distance_km") <= F.lit(radius_km)))


def radius_join(points: DataFrame, centres: DataFrame, radius_km: float,
                lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """J7 (many centres): grid-cell equi-join, then the exact test.

    The globe is cut into rows as high as the radius, and each row into cells
    about as wide as high at its own latitude, so a row near a pole has few.
    A point falls in one cell; a centre lists the cells of three rows that its
    circle may touch, across 180 degrees and the poles.  The equi-join on the
    cell replaces an all-pairs comparison; AQE splits a cell that holds a large
    share of the points.  ``centres`` needs centre_id, centre_lat, centre_lon.
    """
    ang = radius_km / EARTH_RADIUS_KM
    height = max(math.degrees(ang), 1e-6)
    rows = math.ceil(180 / height)

    def row_of(lat):
        return F.least(F.floor((lat + 90) / height), F.lit(rows - 1)).cast("bigint")

    def cells_of(row):
        """How many cells a row has, from the wider of its edges."""
        south, north = row * height - 90, (row + 1) * height - 90
        widest = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(
            F.greatest(F.cos(F.radians(south)), F.cos(F.radians(north))))
        return F.greatest(F.floor(360 * widest / height), F.lit(1)).cast("bigint")

    def cell_of(lon, cells):
        return F.pmod(F.floor((lon + 180) / (F.lit(360.0) / cells)).cast("bigint"), cells)

    pts = points.withColumn("__row", row_of(F.col(lat_col)))
    pts = pts.withColumn("__cell", cell_of(F.col(lon_col), cells_of(F.col("__row"))))
    lat, lon = F.col("centre_lat"), F.col("centre_lon")
    polar = F.abs(lat) + math.degrees(ang) >= 90
    # the sine of the half-width is under 1 where the circle takes in no pole
    half = F.when(polar, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(ang, math.pi / 2))) / F.cos(F.radians(lat))))) + 1e-9)
    cs = centres.withColumn("__half", half).withColumn("__row", F.explode(F.sequence(
        F.greatest(row_of(lat) - 1, F.lit(0).cast("bigint")), F.least(row_of(lat) + 1, F.lit(rows - 1).cast("bigint")))))
    cs = cs.withColumn("__cells", cells_of(F.col("__row")))
    step = F.lit(360.0) / F.col("__cells")
    west = F.floor((lon - F.col("__half") + 180) / step).cast("bigint")
    east = F.floor((lon + F.col("__half") + 180) / step).cast("bigint")
    # a range of cells round the whole row names each cell once
    cs = cs.withColumn("__cell", F.explode(F.sequence(west, F.least(east, west + F.col("__cells") - 1))))
    cs = cs.withColumn("__cell", F.pmod("__cell", "__cells")).drop("__cells", "__half")
    j = pts.join(cs, ["__row", "__cell"])
    d = haversine_km(F.col("centre_lat"), F.col("centre_lon"), F.col(lat_col), F.col(lon_col))
    return j.withColumn("distance_km", d).filter(F.col("distance_km") <= F.lit(radius_km)).drop("__row", "__cell")


# ---------------------------------------------------------------- J8 source map

# Board site name -> source code for the tabular feed.
SITE_TO_SOURCE = (("linkedin", "linkedin"), ("indeed", "indeed"), ("glassdoor", "glassdoor"))


def map_source(df: DataFrame, spark: SparkSession, site: str = "site") -> DataFrame:
    """Inner join with the fixed site -> source table (3 rows, broadcast); unknown sites drop."""
    m = spark.createDataFrame(list(SITE_TO_SOURCE), "__site string, source string")
    return df.join(F.broadcast(m), F.lower(F.col(site).cast("string")) == F.col("__site")).drop("__site")


# ---------------------------------------------------------------- J9 site pages

def site_pages(leads: DataFrame, pages: DataFrame, paths) -> DataFrame:
    """Every lead x (home + contact paths, with their order) x the crawled page.

    The site's trailing '/' is stripped before the (website, path) equi-join.
    ``pages`` needs website, path, page_id, status, html.
    """
    plist = F.array(*[F.lit(p) for p in ["", *paths]])
    frontier = leads.select(
        F.regexp_replace(F.col("website"), "/+$", "").alias("website"),
        F.posexplode(plist).alias("path_ord", "path")).withColumn("path_ord", F.col("path_ord").cast("bigint"))
    return frontier.join(pages.drop("path_ord"), ["website", "path"])
