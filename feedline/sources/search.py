"""The search pages that a run of the card boards visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text

# Search URL shapes of the three card boards.
BUMERAN_BASE = "https://www.bumeran.com.mx"
COMPUTRABAJO_BASE = "https://mx.computrabajo.com"
OCC_BASE = "https://www.occ.com.mx"


def search_urls(terms, city: str, state: str):
    """The crawl frontier -- one row per (board, term, pass) with its search URL.

    The remote pass and (when a city is set) the local pass are two
    projections of the term table, unioned -- no cross join.
    """
    t = text.slugify(F.col("term"))
    c, st = F.lit(city), F.lit(state)
    remote = terms.select(
        "term", F.lit(True).alias("is_remote"),
        F.concat(F.lit(BUMERAN_BASE + "/empleos-busqueda-"), t, F.lit(".html")).alias("bumeran"),
        F.concat(F.lit(COMPUTRABAJO_BASE + "/trabajo-de-"), t).alias("computrabajo"),
        F.concat(F.lit(OCC_BASE + "/empleos/de-"), t, F.lit("/tipo-home-office-remoto/")).alias("occ"))
    if not city:
        return remote
    local = terms.select(
        "term", F.lit(False).alias("is_remote"),
        F.concat(F.lit(BUMERAN_BASE + "/empleos-busqueda-"), t, F.lit("-en-"), text.slugify(c),
                 F.lit(".html")).alias("bumeran"),
        F.concat(F.lit(COMPUTRABAJO_BASE + "/trabajo-de-"), t, F.lit("/en-"), text.slugify(c)).alias("computrabajo"),
        F.concat(F.lit(OCC_BASE + "/empleos/de-"), t, F.lit("/en-"), text.slugify(st), F.lit("/en-"),
                 text.slugify(c), F.lit("/")).alias("occ"))
    return remote.unionByName(local)
