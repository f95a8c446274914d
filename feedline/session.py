"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "feedline",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the settings every flow relies on.

    * UTC session time zone: posted_at is a UTC wall-clock timestamp.
    * AQE on, with skew-join splitting and partition coalescing, so a hot
      fingerprint / site / gram does not pin one task.
    * No UI server.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("FEEDLINE_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def release(spark: SparkSession, wait: float = 0.5) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps whose results are written and whose frames are gone.

    It does so when the driver collects its garbage, which may be long after the
    next step has filled the disks.  Python lets go of its JVM objects a moment
    after it has collected them, hence the waits; without them some go at the next call.
    """
    gc.collect()
    for _ in range(2 if wait else 1):
        time.sleep(wait)
        spark._jvm.System.gc()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and we only read it.  Only when it is unset and the master is local
    -- tests -- do we create a scratch folder of our own; elsewhere that is an error.
    """
    d = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="feedline-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
