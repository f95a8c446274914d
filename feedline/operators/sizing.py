"""Broadcast only behind a counted size.

A plan estimate is no proof (an ``explode`` or a compressed file beats it), so
the only way to a broadcast hint is a row count times a bound per row.  Beyond
the limit nothing is hinted, and the sort-merge plan or adaptive execution,
from measured shuffle sizes, decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 64 MiB: comfortably below executor memory on any cluster we target.
DEFAULT_BROADCAST_LIMIT = 64 << 20
# Bytes per row of a one-key table (64-hex fingerprint + row overhead), generous.
KEY_ROW_BYTES = 128


def broadcast_rows_if_bounded(df: DataFrame, rows: int, row_bytes: int,
                              limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``broadcast(df)`` when a *counted* row number times a per-row bound fits ``limit``."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
