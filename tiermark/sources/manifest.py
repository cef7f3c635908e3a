"""Changes to the files of a partitioned table in two phases, so that a run may stop anywhere.

Beside the table stands a manifest folder with a record for each phase of every run:

  <run>.intent    what the run is about to write, and in which staging folder, before anything is touched
  <run>.prepared  all staged files with their lengths, and the files that they replace, after the staging job has ended
  <run>.finished  after the staged files have been moved in and the replaced ones are gone

The next run first ends what an earlier one began: without a prepared record its staged files are thrown away, with one the
moves are done that are still to do.  A file is moved by a rename, so each file is in one place at any time, and every step can be
repeated.  One run at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from tiermark.sources.files import Store


class Manifest:
    def __init__(self, spark: SparkSession, table: str):
        self.table = table.rstrip("/")
        self.folder, self.staging = self.table + ".manifest", self.table + ".staging"
        self.store = Store(spark, self.table)

    def _records(self, phase: str) -> dict[str, str]:
        """Runs with a record of a phase, in their order."""
        return {n.removesuffix(f".{phase}"): f"{self.folder}/{n}" for n in self.store.files(self.folder) if n.endswith(f".{phase}")}

    def finished(self) -> list[dict]:
        return [self.store.read_record(p) for p in self._records("finished").values()]

    def note(self, run: str, phase: str, record: dict) -> None:
        self.store.write_record(f"{self.folder}/{run}.{phase}", record)

    def recover(self) -> None:
        """End or undo what stopped runs have begun."""
        done, prepared = self._records("finished"), self._records("prepared")
        for run, path in self._records("intent").items():
            if run in done:
                continue
            if run in prepared:
                self.complete(run, self.store.read_record(prepared[run]))
            else:
                self.store.delete(f"{self.staging}/{run}")
                self.store.delete(path)

    def change(self, subject: dict, write: Callable[[str], None], replaced: Callable[[list[str]], dict[str, list[str]]]) -> str:
        """One run.  write(path) stages a table of the same partitions at path; replaced(partitions staged) names the files of the table
        that go, by partition (a partition may be named that has none staged)."""
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.note(run, "intent", subject)
        write(f"{self.staging}/{run}")
        staged = {p: self.store.files(f"{self.staging}/{run}/{p}") for p in self.store.folders(f"{self.staging}/{run}")}
        record = subject | {"staged": staged, "replaced": replaced(list(staged))}
        self.note(run, "prepared", record)
        self.complete(run, record)
        return run

    def complete(self, run: str, record: dict) -> None:
        """Move the staged files in and the replaced ones out, whatever part of that has been done."""
        for partition, names in record["replaced"].items():
            for name in set(names) - set(record["staged"].get(partition, {})):
                self.store.delete(f"{self.table}/{partition}/{name}")
        for partition, names in record["staged"].items():
            there = self.store.files(f"{self.table}/{partition}")
            for name, length in names.items():
                if there.get(name) != length:
                    self.store.move(f"{self.staging}/{run}/{partition}/{name}", f"{self.table}/{partition}/{name}")
        self.note(run, "finished", record)
        self.store.delete(f"{self.staging}/{run}")
