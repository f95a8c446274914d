"""K6: the write-ahead log of a store's runs.

One flat folder of small marker files, read by one listing:

* ``R.intent``: run R has begun; nothing it wrote counts yet;
* ``R.saved-V-N``: its N rows (schema version V) and their keys are whole: from here on
  they are part of the table;
* ``R.commit``: the run is over; the file holds its ledger, ``[saved run, rows saved,
  rows announced]`` each.

A run without a commit broke off.  What it saved and announced is counted from
its own folders by the next run, which then writes the missing commit; what it
had not saved does not count, so the next run that brings those rows saves them.
The ledgers of old runs are folded into a snapshot of what is left of each; a run
that is folded cannot be replayed any more.

One writer at a time: an intent without a commit is a run that broke off, not one
that is still going on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..sources import fs

#: Runs that stay replayable, and runs whose ledgers are read one by one before they are folded.
KEEP, FOLD = 8, 64

Ledger = list[list[int]]


@dataclass
class Runs:
    """What one listing of the log says."""

    begun: set[int] = field(default_factory=set)
    saved: dict[int, tuple[int, int]] = field(default_factory=dict)  #: run -> schema version, rows
    committed: set[int] = field(default_factory=set)
    folded: int = -1  #: all runs up to this one are in the snapshot


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def runs(self) -> Runs:
        out = Runs()
        for name in fs.names(self.spark, self.path):
            run, _, phase = name.partition(".")
            if not run.isdigit():
                continue
            if phase == "intent":
                out.begun.add(int(run))
            elif phase == "commit":
                out.committed.add(int(run))
            elif phase == "snapshot":
                out.folded = max(out.folded, int(run))
            elif phase.startswith("saved-"):
                version, rows = phase.split("-")[1:]
                out.saved[int(run)] = int(version), int(rows)
        return out

    def _file(self, run: int, phase: str) -> str:
        return f"{self.path}/{run:012d}.{phase}"

    def begin(self, run: int) -> None:
        """Takes back what an earlier try of the run published, then writes its intent."""
        now = self.runs()
        if run <= now.folded:
            raise ValueError(f"run {run} is folded: only the last {KEEP} runs can be replayed")
        if run in now.committed:
            fs.delete(self.spark, self._file(run, "commit"))
        fs.put(self.spark, self._file(run, "intent"), "{}")
        if run in now.saved:
            fs.delete(self.spark, self._file(run, "saved-{}-{}".format(*now.saved[run])))

    def save(self, run: int, version: int, rows: int) -> None:
        fs.put(self.spark, self._file(run, f"saved-{version}-{rows}"), "{}")

    def commit(self, run: int, ledger: Ledger) -> None:
        fs.put(self.spark, self._file(run, "commit"), json.dumps(ledger))

    def ledger(self, run: int) -> Ledger:
        return json.loads(fs.get(self.spark, self._file(run, "commit")))

    def snapshot(self, now: Runs) -> dict[int, int]:
        """What is left of each run up to the folded one."""
        if now.folded < 0:
            return {}
        return {int(r): n for r, n in json.loads(fs.get(self.spark, self._file(now.folded, "snapshot"))).items()}

    def fold(self, last: int) -> None:
        """Once ``FOLD`` ledgers are there, folds those of all runs but the last ``KEEP``."""
        now = self.runs()
        open_ = sorted(r for r in now.committed if r > now.folded)
        old = [r for r in open_ if r <= last - KEEP]
        if len(open_) < FOLD or not old or any(r not in now.committed for r in now.begun if r <= old[-1]):
            return
        left = self.snapshot(now)
        add(left, (self.ledger(r) for r in old))
        fs.put(self.spark, self._file(old[-1], "snapshot"), json.dumps({r: n for r, n in left.items() if n}))
        for r in old:  # the snapshot is there: what it covers may go
            for phase in ("intent", "commit"):
                fs.delete(self.spark, self._file(r, phase))
        if now.folded >= 0:
            fs.delete(self.spark, self._file(now.folded, "snapshot"))


def add(left: dict[int, int], ledgers) -> None:
    for ledger in ledgers:
        for run, saved, announced in ledger:
            left[run] = left.get(run, 0) + saved - announced
