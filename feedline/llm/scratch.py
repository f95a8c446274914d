"""Tables that cut lineage, in the folder the session names in ``spark.checkpoint.dir``.

Every executor sees that folder, so a written table survives lost executors.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, release  # noqa: F401 - release: for the operators


class Scratch:
    """Parquet tables under one fresh folder.

    Results read them lazily, so they stay until the driver's Python ends;
    ``drop`` frees a table earlier that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._forget)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema: str) -> DataFrame:
        """What was written to ``name/round=...``."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/round=*")

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table that joins on ``key`` read in place, without a shuffle; the session's catalog knows it as ``name``."""
        df.write.bucketBy(buckets, key).option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _forget(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone by now
            self._delete(self.root)
