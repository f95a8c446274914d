"""Choosing one contact per lead from crawled pages.

Candidates come from X3 (one row per mailto anchor with its page order,
document position and context).  Per lead the choice is

    first HR-context candidate in (path order, page, position), else the
    first candidate at all, else none

which is exactly ``min_by(candidate, (not hr, path_ord, page_id, pos))``: a
single hash aggregate, partial per map task, so a site with a third of all
pages is pre-reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hr_context
from ..schema import LEAD_STATUS_NO_EMAIL, LEAD_STATUS_PENDING


def with_hr_flag(candidates: DataFrame) -> DataFrame:
    """P25: flag candidates whose (lower-cased) context names an HR phrase."""
    return candidates.withColumn("is_hr", hr_context(F.col("context")))


def best_contact(candidates: DataFrame, key: str = "website") -> DataFrame:
    """A3: one (email, is_hr) per ``key``; candidates need path_ord, page_id, pos, email, is_hr."""
    order = F.struct((~F.col("is_hr")).alias("not_hr"), "path_ord", "page_id", "pos")
    return (candidates.groupBy(key)
            .agg(F.min_by(F.struct("email", "is_hr"), order).alias("best"))
            .select(key, F.col("best.email").alias("email"),
                    F.col("best.is_hr").alias("email_is_hr_context")))


def lead_status(email="email"):
    """Pending when an e-mail was found, else no_email_found."""
    return F.when(F.col(email).isNull(), F.lit(LEAD_STATUS_NO_EMAIL)).otherwise(F.lit(LEAD_STATUS_PENDING))


def attach_contacts(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Left-join the chosen contact onto each lead (trailing '/' of the site ignored) and set status."""
    l = leads.withColumn("__site", F.regexp_replace(F.col("website"), "/+$", ""))
    c = contacts.withColumnRenamed("website", "__site")
    j = l.join(c, "__site", "left").drop("__site")
    return (j.withColumn("email_is_hr_context", F.coalesce(F.col("email_is_hr_context"), F.lit(False)))
             .withColumn("status", lead_status()))
