"""The feed registry and the union of enabled feeds.

A feed is a name -> reader over its landing folder.  A reader takes
``(spark, path, search)`` and returns POSTING columns plus ``reason`` (null for
a valid row, F14).  Landed files are one fetched response each; their names
give the fetch order (digit runs count as numbers, so ``page-2`` comes before
``page-10``), and the whole name is the payload's identity.  Adding a feed =
writing a reader and registering it here.

``union_feeds`` reads every enabled feed and concatenates them in configured
order (``seq``: feed, then file, then item).  Feeds are read side by side, each
in a thread and under a job tag of its own, and written to the shared scratch
folder; one that cannot be read, even halfway, or comes to a stop contributes
nothing and is reported, like a failed fetch in a cron run; the other feeds go
on.  Rejected items and responses go to the quarantine table.
"""

from __future__ import annotations

import os
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import InheritableThread

from ..operators.predicates import RESPONSE_REASONS
from ..schema import POSTING, POSTING_COLUMNS
from ..session import ensure_checkpoint_dir
from . import card_feeds, fs, json_feeds, markup_feeds

REJECTED = T.StructType([T.StructField("feed", T.StringType()), *POSTING.fields, T.StructField("reason", T.StringType())])


@dataclass(frozen=True)
class LocalSearch:
    """The local pass of the boards: off without a city or a state."""

    city: str = ""
    enabled: bool = False
    state: str = ""

    @property
    def place(self) -> str:
        """City and state in lower case, or '' while there is no local pass; readers write it as ``title_case_place`` does."""
        parts = [p.strip().lower() for p in (self.city, self.state)]
        return ", ".join(p for p in parts if p) if self.enabled else ""


def landed_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: (payload_id = its whole name below the feed's folder, payload text)."""
    folder = re.escape(os.path.basename(path.rstrip("/")))
    raw = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), f".*/{folder}/(.*)$", 1)
    return raw.select(name.alias("payload_id"), F.col("value").alias("payload"))


# Feeds whose landed files are responses as text; streams read these too.
PAYLOAD_READERS: dict[str, Callable[..., DataFrame]] = {
    "remoteok": json_feeds.read_json_array,
    "remotive": json_feeds.read_json_envelope,
    "himalayas": json_feeds.read_json_salaried,
    "hackernews": json_feeds.read_thread_comments,
    "wwr": markup_feeds.read_rss,
    "getonboard": markup_feeds.read_result_cards,
    "cybersecjobs": markup_feeds.read_list_links,
}


def stream_readers(spark: SparkSession, search: LocalSearch = LocalSearch()) -> dict[str, Callable[..., DataFrame]]:
    """All feeds as readers of landed text: those of ``PAYLOAD_READERS``, and rendered cards and board rows landed as JSON lists."""
    return {**PAYLOAD_READERS,
            "bumeran": card_feeds.landed_cards(card_feeds.read_card_text, "bumeran", search.place),
            "computrabajo": card_feeds.landed_cards(card_feeds.read_card_fields, "computrabajo", search.place),
            "occ": card_feeds.landed_cards(card_feeds.read_card_links, "occ", search.place),
            "jobspy": card_feeds.landed_board(spark, search.place)}


def _payload_reader(fn):
    return lambda spark, path, search: fn(landed_payloads(spark, path), with_rejects=True)


def _card_reader(fn):
    """Rendered cards land as rows; without a local search only the remote passes count."""
    def read(spark, path, search):
        cards = spark.read.parquet(path)
        cards = cards if search.place else cards.filter("is_remote")
        return fn(cards, city=search.place, with_rejects=True)
    return read


def _tabular(spark, path, search):
    """Tabular rows land as two tables: <path>/remote and, with a local search, <path>/local."""
    local = os.path.join(path, "local")
    rows = spark.read.parquet(local) if search.place and fs.exists(spark, local) else None
    return card_feeds.read_tabular_passes(spark, spark.read.parquet(os.path.join(path, "remote")), rows, with_rejects=True)


FEEDS: dict[str, Callable[[SparkSession, str, LocalSearch], DataFrame]] = {
    **{name: _payload_reader(fn) for name, fn in PAYLOAD_READERS.items()},
    "bumeran": _card_reader(card_feeds.read_card_text),
    "computrabajo": _card_reader(card_feeds.read_card_fields),
    "occ": _card_reader(card_feeds.read_card_links),
    "jobspy": _tabular,
}


def register_feed(name: str, reader: Callable[[SparkSession, str, LocalSearch], DataFrame]) -> None:
    FEEDS[name] = reader


def at_feed(seq: F.Column, feed: int) -> F.Column:
    """A row's place with its feed's number in front."""
    return F.struct(F.lit(feed).alias("feed"), seq["payload"].alias("payload"), seq["pos"].alias("pos"))


# Fixed value: seconds that a feed may go without ending a task.
FEED_SECONDS = 120.0
FEEDS_AT_ONCE = 4


def _progress(sc: SparkContext, tag: str) -> tuple[tuple[int, int], bool]:
    """Jobs begun and tasks ended under a tag, and whether its next tasks only wait for cores."""
    status = sc.statusTracker()
    jobs, live = list(sc._jsc.sc().statusTracker().getJobIdsForTag(tag)), set(status.getActiveStageIds())
    ids = {s for j in jobs if (job := status.getJobInfo(j)) for s in job.stageIds}
    stages = {s: info for s in ids if (info := status.getStageInfo(s))}
    running = any(info.numActiveTasks for info in stages.values())
    return (len(jobs), sum(info.numCompletedTasks for info in stages.values())), not running and bool(live & stages.keys())


def _side_by_side(spark: SparkSession, names, work: Callable[[str], object], seconds: float, at_once: int) -> dict[str, object]:
    """``work(name)`` for each name, ``at_once`` at a time: its result, or the exception that ended it.

    Each runs in a thread of its own whose Spark jobs bear a tag; once none of its
    tasks has ended for ``seconds`` the jobs of its tag are cancelled and the thread
    is left to itself.  A large feed takes its time, as does one that waits for cores.
    """
    sc, out, started, seen = spark.sparkContext, {}, {}, {}
    tags = {name: f"feed-{uuid.uuid4().hex}" for name in names}
    free = threading.Semaphore(at_once)

    def run(name: str) -> None:
        with free:
            if name in out:
                return
            started[name] = time.monotonic()
            sc.addJobTag(tags[name])
            try:
                got = work(name)
            except Exception as e:  # noqa: BLE001 - handed to the caller
                got = e
            finally:
                sc.removeJobTag(tags[name])
            out.setdefault(name, got)

    threads = {name: InheritableThread(target=run, args=(name,), session=spark, daemon=True) for name in names}
    for t in threads.values():
        t.start()
    look = 0.0
    while len(out) < len(threads):
        time.sleep(0.02)
        if time.monotonic() < look:
            continue
        look = time.monotonic() + min(1.0, seconds / 20)
        for name in [n for n in started if n not in out]:
            done, waits = _progress(sc, tags[name])
            if waits or seen.get(name) != done:
                seen[name], started[name] = done, time.monotonic()
            elif time.monotonic() - started[name] > seconds:
                out.setdefault(name, TimeoutError(f"ended no task for {seconds:g} s"))
                sc.cancelJobsWithTag(tags[name])
                free.release()  # a thread that hangs does not keep its place
    return out


def concat_feeds(spark: SparkSession, enabled, read: Callable[[str], DataFrame], root: str, seconds: float = FEED_SECONDS,
                 at_once: int = FEEDS_AT_ONCE) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(valid rows, rejected rows, {feed: error}) of ``read(feed)`` for each enabled feed, under ``root``.

    Feeds are read side by side, each as long as one of its tasks ends every ``seconds``.  A feed whose
    responses all gave nothing is an error too, and its rejects say why.
    """
    order = list(enabled)

    def land(name: str) -> tuple[T.StructType, str | None]:
        rows = read(name)
        rows = rows.select(at_feed(F.col("seq"), order.index(name)).alias("seq"), *(c for c in rows.columns if c != "seq"))
        path = f"{root}/feed={name}"
        rows.write.mode("overwrite").option("compression", fs.CODEC).parquet(path)  # a feed that cannot be read fails here, by itself
        said = spark.read.schema(rows.schema).parquet(path).groupBy("reason").count().collect()  # a few reasons
        counts = {r.reason: r["count"] for r in said}
        bad = {k: n for k, n in counts.items() if k in RESPONSE_REASONS}
        nothing = bad and None not in counts
        return rows.schema, "ResponseError: " + ", ".join(f"{n} x {k}" for k, n in sorted(bad.items())) if nothing else None

    landed = _side_by_side(spark, order, land, seconds, at_once)
    tagged, failed = spark.createDataFrame([], REJECTED), {}
    for name in order:
        got = landed[name]
        if isinstance(got, Exception):  # contributes nothing, and is reported
            failed[name] = f"{type(got).__name__}: {str(got)[:200]}"
            continue
        schema, error = got
        if error:
            failed[name] = error
        tagged = tagged.unionByName(spark.read.schema(schema).parquet(f"{root}/feed={name}").withColumn("feed", F.lit(name)))
    valid = tagged.filter("reason is null").select(*POSTING_COLUMNS)
    return valid, tagged.filter("reason is not null"), failed


def feeds_root(spark: SparkSession) -> str:
    """A new folder for what the feeds of one run give."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/feeds-{uuid.uuid4().hex}"


def union_feeds(spark: SparkSession, landing_root: str, enabled, search: LocalSearch = LocalSearch(),
                quarantine: str | None = None, seconds: float = FEED_SECONDS, root: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(all enabled feeds' postings, {feed: error} for feeds that contributed nothing).

    Rejected items are written to ``quarantine`` (replaced as a whole), if given.
    What the feeds gave is kept under ``root`` (a folder of its own by default)
    for the caller to delete once it has used the rows.
    """
    root = root or feeds_root(spark)
    valid, rejected, failed = concat_feeds(
        spark, enabled, lambda name: FEEDS[name](spark, os.path.join(landing_root, name), search), root, seconds)
    if quarantine:
        rejected.write.mode("overwrite").parquet(quarantine)
    return valid, failed
