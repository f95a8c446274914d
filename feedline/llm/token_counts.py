"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch holds inserts, deletes and revised counts of documents.  Committing it
compares each changed document with its state before the batch and writes

* ``changes/batch=N``: the documents' new state (no count: deleted), and
* ``deltas/batch=N``: signed documents and tokens per group, a few rows.

Totals are the sum of the committed deltas, so a commit never reads documents
that it does not change.  A batch counts once its marker ``commits/batch=N`` is
there, which is written last: a batch that broke off is written anew as a
whole, one that is committed already is left alone, and both leave the totals right.
``compact`` folds the changes so far into one state, so that a commit reads
that and the later batches only.

Batches have ascending numbers.  In one batch the change with the largest ``seq``
of a document and version counts (ties: the largest tokens, then source, then language).
An insert of a known document revises it, a delete or revision of an unknown
one does nothing.  A null id is one document; null sources, languages and
versions are groups; a null count is 0.  An empty batch commits and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import frugal

STATE = "doc_id long, version string, source string, lang string, tokens long, known boolean"
DELTA = "source string, lang string, version string, docs long, tokens long"
GROUP = ["source", "lang", "version"]


class TokenTotals:
    """The tables under ``root``, a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batches(self, kind: str) -> list[int]:
        path = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(path):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(path))
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def committed(self) -> list[int]:
        return self._batches("commits")

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        path = f"{self.root}/{kind}"
        return self.spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(*(f"{path}/batch={b}" for b in batches))

    def state(self) -> DataFrame:
        """``doc_id, version, source, lang, tokens`` of the documents that are counted now."""
        return self._state().filter("known").drop("known")

    def _state(self) -> DataFrame:
        done = self.committed()
        folded = [b for b in self._batches("state-commits") if b in done]
        base = folded[-1:]
        later = [b for b in done if not base or b > base[0]]
        rows = self._read("state", base, STATE).unionByName(self._read("changes", later, STATE))
        last = rows.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "known"), "batch").alias("s"))
        return last.select("doc_id", "version", "s.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies ``changes(doc_id, version, op, source, lang, tokens, seq)``; ``op`` is insert, revise or delete.

        False if the batch is committed already.  A revision keeps source and
        language where it gives none.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        last = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("string").alias("version")).agg(F.max(F.struct(
            F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"),
            F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("op").alias("op"))).alias("new"))
        old = self._state().filter("known").select(
            F.col("doc_id").alias("d"), F.col("version").alias("v"), F.struct("source", "lang", "tokens").alias("old"))
        both = last.join(old, last.doc_id.eqNullSafe(old.d) & last.version.eqNullSafe(old.v), "left")
        was, op = F.col("old").isNotNull(), F.col("new.op")
        both = both.filter(was | (op == "insert"))
        keep = (op == "revise") & was
        rows = both.select(
            "doc_id", "version",
            F.when(keep, F.coalesce("new.source", "old.source")).otherwise(F.col("new.source")).alias("source"),
            F.when(keep, F.coalesce("new.lang", "old.lang")).otherwise(F.col("new.lang")).alias("lang"),
            F.when(op != "delete", F.col("new.tokens")).alias("tokens"), (op != "delete").alias("known"), "old")
        rows.select("doc_id", "version", "source", "lang", "tokens", "known", "old").write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/changes/batch={batch}")
        # one signed row for what a document gives now, one for what it gave before
        signed = written.select(F.explode(F.array(
            F.when(F.col("known"), F.struct("source", "lang", "version", F.lit(1).alias("docs"), "tokens")),
            F.when(F.col("old").isNotNull(), F.struct(F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), "version",
                                                      F.lit(-1).alias("docs"), (-F.col("old.tokens")).alias("tokens"))))).alias("x")).filter("x is not null").select("x.*")
        sums = signed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        self._mark("commits", batch)
        return True

    def _mark(self, kind: str, batch: int) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{kind}/batch={batch}"))

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` of the groups that hold a document."""
        sums = self._read("deltas", self.committed(), DELTA).groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0")

    def compact(self) -> None:
        """Folds all committed changes into one state."""
        done = self.committed()
        if done:
            self._state().filter("known").write.mode("overwrite").parquet(f"{self.root}/state/batch={done[-1]}")
            self._mark("state-commits", done[-1])


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, version: str, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """``keep`` columns, ``version`` and ``tokens``: ids of each whole text by the rank file of a public tokenizer.

    A null text has none; the file, of fixed size, is read by the driver and broadcast.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(t.as_py())) for t in b.column("__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, "tokens"])

    schema = docs.select(*keep).schema.add("tokens", "long")
    return rows.mapInArrow(frugal(scan), schema).withColumn("version", F.lit(version))


_MADE: dict[tuple[int, str], object] = {}


def _encoding(ranks: bytes, pattern: str):
    """One per worker process and rank file."""
    import base64

    import tiktoken

    key = hash(ranks), pattern
    if key not in _MADE:
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
        _MADE[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _MADE[key]
