"""Name -> query callable registry used by the driver entry point."""

from __future__ import annotations

import functools

from ..session import ensure_checkpoint_dir

QUERIES: dict = {}


def register(name):
    """Register ``fn(spark, base) -> DataFrame`` under ``name``.

    The library's timestamps are UTC wall clocks, so the session time zone is
    pinned to UTC, and the shared checkpoint folder is resolved (read from
    ``spark.checkpoint.dir``; a scratch folder only where it is unset).
    """
    def deco(fn):
        @functools.wraps(fn)
        def wrapped(spark, base):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ensure_checkpoint_dir(spark)
            return fn(spark, base)
        QUERIES[name] = wrapped
        return wrapped
    return deco


def packed(df):
    """``df`` with ``seq`` as one number, to compare with SQL: landed test payloads hold at most 50 items each."""
    from pyspark.sql import functions as F

    return df.withColumn("seq", F.col("seq.payload").cast("bigint") * (1 << 20) + F.col("seq.pos"))
