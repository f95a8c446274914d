"""Reading the landed tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``<base>/<name>.parquet`` (file or folder of parts)."""
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a single split, which would run in one task.

    A split is bounded (``spark.sql.files.maxPartitionBytes``), so at most that
    much is ever shuffled; anything larger has several splits and is left alone.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df
