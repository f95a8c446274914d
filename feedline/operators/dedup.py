"""A1 / A2: order-aware deduplication.

Spark rows carry no order, so every input carries an explicit ``seq``.

* A1 ``dedup_last_value_first_position``: one row per key holding the values
  of the **last** occurrence at the position (``seq``) of the **first** one --
  what a dict comprehension over an ordered list does.
* A2 ``dedup_first``: one row per key, the first occurrence.

Both are ``groupBy(key).agg(max_by/min_by(struct, seq))``: partial
aggregation runs map-side, so a key holding a third of all rows is reduced to
one row per map task before the shuffle and never lands whole on one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def dedup_last_value_first_position(df: DataFrame, key="fingerprint", order: str = "seq") -> DataFrame:
    keys = _keys(key)
    payload = [c for c in df.columns if c not in keys and c != order]
    agg = df.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.col(order)).alias("__last"),
        F.min(order).alias(order),
    )
    return agg.select(*keys, order, *[F.col("__last")[c].alias(c) for c in payload]).select(*df.columns)


def new_last_value_first_position(df: DataFrame, run: int, key: str = "fingerprint", order: str = "seq",
                                  run_col: str = "run_no") -> DataFrame:
    """A1 + J2 in ONE aggregation, for when batch and history live in the same table.

    Per key: the values of the last row of run ``run`` at the position of its
    first row, kept only when no earlier run has the key.  One scan, one
    shuffle (partial aggregation map-side), no join -- where a separate
    history table exists, use ``joins.new_rows`` (J1 semi-join reduction).
    """
    payload = [c for c in df.columns if c not in (key, order, run_col)]
    now = F.col(run_col) == F.lit(run)
    agg = df.groupBy(key).agg(
        F.max_by(F.when(now, F.struct(*payload)), F.when(now, F.col(order))).alias("__last"),
        F.min(F.when(now, F.col(order))).alias(order),
        F.max((F.col(run_col) < F.lit(run)).cast("int")).alias("__seen"))
    kept = agg.filter(F.col(order).isNotNull() & (F.col("__seen") == 0))
    return kept.select(key, order, *[F.col("__last")[c].alias(c) for c in payload])


def dedup_first(df: DataFrame, key="url", order: str = "seq") -> DataFrame:
    keys = _keys(key)
    payload = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.col(order)).alias("__first"))
    return agg.select(*keys, *[F.col("__first")[c].alias(c) for c in payload]).select(*df.columns)
