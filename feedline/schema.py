"""POSTING and LEAD schemas and the closed source domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed set of posting sources (must equal the reference's enum).
KNOWN_SOURCES = (
    "linkedin", "indeed", "glassdoor", "remoteok", "remotive", "weworkremotely",
    "cybersecjobs", "computrabajo", "bumeran", "himalayas", "hackernews", "occ",
    "getonboard",
)

# Feed names a run may enable (must equal the reference's registry names).
KNOWN_FEEDS = (
    "jobspy", "remoteok", "remotive", "wwr", "cybersecjobs", "computrabajo", "bumeran",
    "himalayas", "hackernews", "occ", "getonboard",
)

# The place of a row: feed order, then the landed file, then the position in it.
# A struct sorts field by field, so no field can run into the next one.
PLACE = T.StructType([
    T.StructField("feed", T.IntegerType(), False),
    T.StructField("payload", T.StringType(), True),
    T.StructField("pos", T.LongType(), True),
])

POSTING = T.StructType([
    T.StructField("seq", PLACE, False),
    T.StructField("title", T.StringType(), False),
    T.StructField("company", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("is_remote", T.BooleanType(), False),
    T.StructField("description", T.StringType(), False),
    # UTC wall clock (the session time zone is forced to UTC).
    T.StructField("posted_at", T.TimestampNTZType(), True),
    T.StructField("min_salary_usd_monthly", T.DoubleType(), True),
])
POSTING_COLUMNS = [f.name for f in POSTING.fields]

LEAD = T.StructType([
    T.StructField("seq", PLACE, False),
    T.StructField("name", T.StringType(), False),
    T.StructField("website", T.StringType(), False),
    T.StructField("latitude", T.DoubleType(), False),
    T.StructField("longitude", T.DoubleType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("email_is_hr_context", T.BooleanType(), False),
    T.StructField("status", T.StringType(), False),
])
LEAD_COLUMNS = [f.name for f in LEAD.fields]

LEAD_STATUS_PENDING = "pending"
LEAD_STATUS_NO_EMAIL = "no_email_found"


def place(payload: Column, pos: Column, feed: int = 0) -> Column:
    """PLACE of an item: ``payload`` is a landed file's name or number, in natural order."""
    return F.struct(F.lit(feed).cast("int").alias("feed"), natural_key(payload).alias("payload"),
                    pos.cast("bigint").alias("pos"))


def natural_key(name: Column) -> Column:
    """A text that sorts like ``name`` with its digit runs as numbers; different names stay different."""
    runs = F.regexp_extract_all(name.cast("string"), F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(runs, lambda t: F.when(
        t.rlike(r"^\d"), F.lpad(t, F.greatest(F.length(t), F.lit(20)), F.lit("0"))).otherwise(t))
    return F.array_join(padded, "")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema`` (order, names, types); missing columns become null."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
