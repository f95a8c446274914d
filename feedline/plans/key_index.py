"""The keys of an ever-growing history as sorted segments, merged in levels.

A run adds one segment: its keys sorted, in files that know their smallest and
largest key and carry a Bloom filter.  ``FANOUT`` segments of a level are merged
into one of the next, so 1,000 runs are read from some two dozen segments and a
key is rewritten once a level.  A manifest, published as a whole, names the merged
segments; the segments they replace are deleted one merge later, when no reader of
the manifest before can be at them.

The last ``KEEP`` runs are never merged: a replay replaces its own segment.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import new_rows
from ..sources import fs
from .run_log import KEEP, Runs

FANOUT = 8
KEYS_A_FILE = 4_000_000
FEW = 200  #: keys of a batch that are looked for by value, so that files are skipped by their Bloom filters
KEY = T.StructType([T.StructField("fingerprint", T.StringType())])


@dataclass(frozen=True)
class Segment:
    level: int
    first: int
    last: int
    rows: int

    @property
    def name(self) -> str:
        return f"run_id={self.first}" if not self.level else f"level={self.level}/runs={self.first}-{self.last}"


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # ------------------------------------------------------------ segments

    def _manifests(self) -> list[str]:
        return [n for n in fs.names(self.spark, self.path) if n.startswith("manifest-")]

    def merged(self) -> list[Segment]:
        names = self._manifests()
        return [Segment(**s) for s in json.loads(fs.get(self.spark, f"{self.path}/{names[-1]}"))["live"]] if names else []

    def segments(self, runs: Runs, before: int) -> list[Segment]:
        """What holds the keys of the saved runs before ``before``."""
        merged = self.merged()
        done = max((s.last for s in merged), default=-1)
        if before <= done:
            raise ValueError(f"keys up to run {done} are merged: run {before} cannot be replayed any more")
        return merged + [Segment(0, r, r, rows) for r, (_, rows) in sorted(runs.saved.items()) if done < r < before and rows]

    def _read(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], KEY)
        return self.spark.read.schema(KEY).parquet(*(f"{self.path}/{s.name}" for s in segments))

    def keys(self, runs: Runs, before: int) -> DataFrame:
        return self._read(self.segments(runs, before))

    def _write(self, keys: DataFrame, segment: Segment) -> None:
        files = max(1, -(-segment.rows // KEYS_A_FILE))
        (keys.repartitionByRange(files, "fingerprint").sortWithinPartitions("fingerprint").write.mode("overwrite")
         .option("parquet.bloom.filter.enabled#fingerprint", "true")
         .option("parquet.bloom.filter.expected.ndv#fingerprint", str(-(-max(1, segment.rows) // files)))
         .parquet(f"{self.path}/{segment.name}"))

    # ------------------------------------------------------------ use

    def new_rows(self, batch: DataFrame, rows: int, runs: Runs, before: int) -> DataFrame:
        """Rows of a materialised batch of ``rows`` rows whose keys the history does not hold.

        A few keys are looked for by value (files whose bounds or Bloom filters
        lack them are not read); more are joined, broadcast if counted as small.
        """
        history = self.keys(runs, before)
        if 0 < rows <= FEW:
            keys = [r[0] for r in batch.select("fingerprint").distinct().collect()]  # at most FEW
            # ten at a time: longer lists are pushed to the files as bounds only
            tens = [F.col("fingerprint").isin(keys[i:i + 10]) for i in range(0, len(keys), 10)]
            history = history.filter(reduce(lambda a, b: a | b, tens))
        return new_rows(batch, history, "fingerprint", rows)

    def add(self, keys: DataFrame, run: int, rows: int) -> None:
        """The segment of a run, in place of one that an earlier try left."""
        if rows:
            self._write(keys, Segment(0, run, run, rows))
        else:
            fs.delete(self.spark, f"{self.path}/{Segment(0, run, run, 0).name}")

    def merge(self, runs: Runs, last: int) -> None:
        """Merges full levels of the runs that cannot be replayed any more."""
        live = self.merged()
        done = max((s.last for s in live), default=-1)
        old = [r for r in sorted(runs.begun | set(runs.saved)) if done < r <= last - KEEP]
        single = [Segment(0, r, r, runs.saved[r][1]) for r in old if runs.saved.get(r, (0, 0))[1]]
        gone: list[Segment] = []
        if len(single) < FANOUT:
            return
        live += [self._merged(1, single[:FANOUT])]
        gone += single[:FANOUT]
        level = 1
        while len(full := [s for s in live if s.level == level]) >= FANOUT:
            live = [s for s in live if s.level != level] + [self._merged(level + 1, full)]
            gone += full
            level += 1
        names = self._manifests()
        fs.put(self.spark, f"{self.path}/manifest-{len(names):012d}", json.dumps({"live": [asdict(s) for s in live], "gone": [asdict(s) for s in gone]}))
        if names:
            for s in json.loads(fs.get(self.spark, f"{self.path}/{names[-1]}"))["gone"]:
                fs.delete(self.spark, f"{self.path}/{Segment(**s).name}")

    def _merged(self, level: int, of: list[Segment]) -> Segment:
        out = Segment(level, min(s.first for s in of), max(s.last for s in of), sum(s.rows for s in of))
        self._write(self._read(of), out)
        return out
