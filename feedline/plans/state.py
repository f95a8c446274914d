"""Incremental state as append-only tables.

The reference keeps one mutable row per key (insert-or-ignore, then
``UPDATE ... SET notified=1``).  Here every fact is append-only, and each run
writes folders of its own:

* ``<table>/run_id=R`` (K1 / K2): the rows that run R saw first, under the version of
  the columns it was written with (``schema_log``);
* ``<table>_keys``: their fingerprints, as sorted segments merged in levels (``key_index``, J1);
* ``<table>_notifications/run_id=R/kind=K`` (K3): what run R announced -- the
  "notified" flag is the existence of a row;
* ``<table>_log``: how far each run came and, once it is over, how many announceable
  rows it saved and announced (``run_log``).

A run publishes in steps: its intent, what the retry announced, its rows and keys
together, what it announced of them, its commit.  A run that broke off between two
of them is found by the next one and counted from its own folders (K5), so what it
saved is retried and what it did not save is still new.

Pending rows are those saved and not announced (S15 / S16), oldest run first.
The ledgers say which runs have any, so a retry reads the rows of the few
oldest such runs, never the history, and nothing is ever rewritten.

A run reads only runs before it and replaces its folders as a whole, also
with nothing, so a replay after a failure gives the same tables (K6).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import dedup_first
from ..operators.digest import digest_slice
from ..operators.joins import new_rows
from ..operators.predicates import valid_posting
from ..schema import conform
from ..session import ensure_checkpoint_dir
from ..sources import fs
from .key_index import KeyIndex
from .run_log import Ledger, RunLog, Runs, add
from .schema_log import SchemaLog

# ---------------------------------------------------------------- pure operators

def insert_ignore(batch: DataFrame, history: DataFrame, key: str = "fingerprint",
                  batch_rows: int | None = None) -> DataFrame:
    """The rows an insert-or-ignore would add -- first occurrence per key, absent from history.

    ``batch_rows`` (a counted upper bound on the batch's keys) lets J1/J2
    broadcast the batch side instead of shuffling the history.
    """
    return new_rows(dedup_first(batch, key), history.select(key), key, batch_rows)


def pending(table: DataFrame, notifications: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Saved rows without a notification (semi-join reduction is not needed: the
    notification log is the smaller side and is anti-joined as is)."""
    return table.join(notifications.select(key).distinct(), key, "left_anti")


def pending_leads(table: DataFrame, notifications: DataFrame) -> DataFrame:
    """Leads with an e-mail and no notification."""
    return pending(table.filter(F.col("email").isNotNull()), notifications)


def marks(rows: DataFrame, n: int, run_id: int, kind: str, key: str = "fingerprint") -> DataFrame:
    """Notification rows for the first ``n`` rows (the ones the digest showed)."""
    return digest_slice(rows, n).select(key, F.lit(run_id).cast("bigint").alias("run_id"),
                                        F.lit(kind).alias("kind"))


# ---------------------------------------------------------------- file-backed store

#: ``send(rows, total, run_id, kind)``: delivers the digest's rows (at most its size) out of ``total``.
Send = Callable[[DataFrame, int, int, str], bool]

NOTE = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("saved_run", T.LongType()),
                     T.StructField("sent_at", T.TimestampNTZType())])
STAMP = T.StructType([T.StructField("created_at", T.TimestampNTZType()), T.StructField("run_id", T.LongType())])


@dataclass
class RunReport:
    run_id: int
    retried: int
    retry_sent: bool
    inserted: int
    sent: bool


class Store:
    """Append-only postings (or leads) table plus its notification log under ``root``.

    ``schema``: columns that a saved row has from the start; those that later
    batches bring are added, those they lack read as null.
    """

    def __init__(self, spark: SparkSession, root: str, table: str = "postings", leads: bool = False,
                 schema: T.StructType | None = None):
        """``leads=True``: pending means "has an e-mail and no notification" (S16) and only
        leads with an e-mail are announced; otherwise pending rows are re-validated (S15)."""
        self.spark = spark
        self.leads = leads
        ensure_checkpoint_dir(spark)
        base = f"{root.rstrip('/')}/{table}"
        self.table_path, self.notes_path = base, f"{base}_notifications"
        self.log, self.index, self.schemas = RunLog(spark, f"{base}_log"), KeyIndex(spark, f"{base}_keys"), SchemaLog(spark, f"{base}_schema")
        if schema is not None:
            self.schemas.admit(schema)

    # ------------------------------------------------------------ tables

    def rows(self, before_run: int | None = None, runs: list[int] | None = None) -> DataFrame | None:
        """Saved rows, each run read under its own columns (None while there are none to name)."""
        latest = self.schemas.latest()
        if latest < 0:
            return None
        saved = self.log.runs().saved
        of: dict[int, list[int]] = {}
        for run, (version, n) in sorted(saved.items()):
            if n and (run in runs if runs is not None else before_run is None or run < before_run):
                of.setdefault(version, []).append(run)
        full = T.StructType([*self.schemas.version(latest), *STAMP])
        out = None if of else self.spark.createDataFrame([], full)
        for version, some in of.items():
            fields = T.StructType([*self.schemas.version(version), *STAMP])
            read = self.spark.read.schema(fields).option("basePath", self.table_path).parquet(*(f"{self.table_path}/run_id={r}" for r in some))
            read = conform(read, full)
            out = read if out is None else out.unionByName(read)
        return out

    def notifications(self, before_run: int | None = None, since: int | None = None) -> DataFrame:
        """K3: what the runs from ``since`` on and before ``before_run`` announced."""
        runs = sorted(int(n.removeprefix("run_id=")) for n in fs.names(self.spark, self.notes_path) if n.startswith("run_id="))
        runs = [r for r in runs if (before_run is None or r < before_run) and (since is None or r >= since)]
        fields = T.StructType([*NOTE, T.StructField("run_id", T.LongType()), T.StructField("kind", T.StringType())])
        if not runs:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", self.notes_path).parquet(*(f"{self.notes_path}/run_id={r}" for r in runs))

    def unseen(self, batch: DataFrame, run_id: int) -> DataFrame:
        """J1 + J2: rows of ``batch`` whose keys no run before ``run_id`` saved, by the key index alone."""
        batch = batch.checkpoint()  # counted, then read again: the count proves whether its keys may be broadcast
        return self.index.new_rows(batch, batch.count(), self.log.runs(), run_id)

    # ------------------------------------------------------------ pending

    def announceable(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("email").isNotNull()) if self.leads else rows.filter(valid_posting())

    def _ledger(self, run: int, now: Runs) -> Ledger:
        """What a run saved and announced; of one that broke off, counted from its own folders."""
        if run in now.committed:
            return self.log.ledger(run)
        told = [[r.saved_run, 0, r["count"]] for r in self.notifications(run + 1, run).groupBy("saved_run").count().collect()]
        return [[run, self.announceable(self.rows(runs=[run])).count(), 0], *told] if run in now.saved else told

    def _broken(self, now: Runs, before_run: int | None) -> list[int]:
        return sorted(r for r in now.begun - now.committed if r > now.folded and (before_run is None or r < before_run))

    def open_runs(self, before_run: int | None = None) -> dict[int, int]:
        """Saved run -> announceable rows still pending, oldest first (one entry per run)."""
        now = self.log.runs()
        left = self.log.snapshot(now)
        runs = sorted(r for r in now.begun | now.committed if r > now.folded and (before_run is None or r < before_run))
        add(left, (self._ledger(r, now) for r in runs))
        return {r: n for r, n in sorted(left.items()) if n > 0}

    def recover(self, before_run: int | None = None) -> list[int]:
        """Writes the commits that runs before ``before_run`` did not come to; the runs."""
        now = self.log.runs()
        broken = self._broken(now, before_run)
        for run in broken:
            self.log.commit(run, self._ledger(run, now))
        return broken

    def _pending_of(self, runs: list[int], before_run: int | None) -> DataFrame:
        # a row is announced by the run that saved it or by a later one
        notes = self.notifications(before_run, min(runs, default=0)).filter(F.col("saved_run").isin(runs))
        return self.announceable(pending(self.rows(runs=runs), notes))

    def pending(self, before_run: int | None = None) -> DataFrame | None:
        """Rows pending before ``before_run`` (all runs when None)."""
        return None if self.schemas.latest() < 0 else self._pending_of(list(self.open_runs(before_run)), before_run)

    def pending_by_full_scan(self, before_run: int | None = None) -> DataFrame | None:
        """The same set as ``pending`` computed from the whole history (for checks)."""
        rows = self.rows(before_run)
        return None if rows is None else self.announceable(pending(rows, self.notifications(before_run)))

    def oldest_pending(self, before_run: int, n: int) -> tuple[DataFrame | None, int]:
        """The first ``n`` pending rows, materialised, and how many are pending in all.

        Reads the oldest open runs that hold ``n`` rows by the ledger, and more
        only if some of those rows are unreadable by now.
        """
        left = self.open_runs(before_run)
        total, take, runs = sum(left.values()), 0, []
        for run, k in left.items():
            runs.append(run)
            take += k
            if take < n and run != list(left)[-1]:
                continue
            rows = digest_slice(self._pending_of(runs, before_run), n).checkpoint()
            if rows.count() >= min(n, total) or run == list(left)[-1]:
                return rows, total
        return None, 0

    # ------------------------------------------------------------ a run

    def insert(self, batch: DataFrame, run_id: int) -> int:
        """J3 + A4: write the new rows of ``batch`` as run ``run_id``; return their count."""
        if run_id not in self.log.runs().begun:
            self.log.begin(run_id)
        version = self.schemas.admit(T.StructType([f for f in batch.schema if f.name not in STAMP.fieldNames()]))
        # Materialise the batch in the shared checkpoint folder (cuts lineage, survives executor loss).
        batch = dedup_first(conform(batch, self.schemas.version(version)), "fingerprint").checkpoint()
        new = self.index.new_rows(batch, batch.count(), self.log.runs(), run_id)
        out = new.withColumn("created_at", F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None)))
        path = f"{self.table_path}/run_id={run_id}"
        out.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(T.StructType([T.StructField("fingerprint", T.StringType())])).parquet(path)
        rows = saved.count()
        self.index.add(saved, run_id, rows)
        self.log.save(run_id, version, rows)
        return rows

    def mark(self, rows: DataFrame | None, run_id: int, kind: str) -> dict[int, int]:
        """Log notifications for ``rows``; how many per run that saved them."""
        empty = self.spark.createDataFrame([], NOTE)
        notes = empty if rows is None else rows.select(
            "fingerprint", F.col("run_id").alias("saved_run"), F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None)).alias("sent_at"))
        notes.coalesce(1).write.mode("overwrite").parquet(f"{self.notes_path}/run_id={run_id}/kind={kind}")
        return {} if rows is None else {r.run_id: r["count"] for r in rows.groupBy("run_id").count().collect()}

    def run(self, batch: DataFrame, run_id: int, digest_size: int, send: Send) -> RunReport:
        """K5 + K6: retry pending first, then save, send, mark (a failed send leaves rows pending).

        The rows of a digest are chosen once: ``send`` gets what is then
        marked.  An empty set is never sent.  A ``send`` that raises breaks the
        run off like a crash; the next run takes up what was saved.
        """
        self.recover(run_id)
        self.log.begin(run_id)
        fs.delete(self.spark, f"{self.notes_path}/run_id={run_id}")
        moved: dict[int, list[int]] = {}

        def announce(rows, total, kind):
            ok = bool(rows is not None and rows.count() and send(rows, total, run_id, kind))
            for run, k in self.mark(rows if ok else None, run_id, kind).items():
                moved.setdefault(run, [0, 0])[1] += k
            return ok

        rows, retried = self.oldest_pending(run_id, digest_size)
        retry_sent = announce(rows, retried, "retry")
        inserted = self.insert(batch, run_id)
        new = self.announceable(self.rows(runs=[run_id]))
        fresh = new.count()
        moved.setdefault(run_id, [0, 0])[0] = fresh
        sent = announce(digest_slice(new, digest_size).checkpoint() if fresh else None, fresh, "new")
        self.log.commit(run_id, [[r, s, k] for r, (s, k) in moved.items()])
        self.log.fold(run_id)
        self.index.merge(self.log.runs(), run_id)
        return RunReport(run_id, retried, retry_sent, inserted, sent)
