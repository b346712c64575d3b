"""Processing only new or changed records.

``Ledger`` runs a job over a table that only grows, once for every record: a high watermark on a monotonic sequence
number, an upper limit fixed at the start of a run, and one commit that publishes the output and the new watermark
together. ``pending`` answers from a history of runs which records are still to do, and ``take_pending`` is the job
that does so under a ledger.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.intervals import periods, uncovered
from tidelog.plans.storage import cut


def lasting_runs(runs: DataFrame) -> DataFrame:
    """(run_id) of the runs whose status entry with the highest seq says committed, letter case and outer blanks aside.

    Clock times decide nothing. Repeated entries are harmless; of different statuses at one seq the last in text
    order counts, so that 'failed' and 'revoked' beat 'committed'. Entries with a null run or seq are not entries.
    """
    entries = runs.filter("run_id is not null and seq is not null").select("run_id", "seq", F.lower(F.trim(F.regexp_replace("status", r"\s+", " "))).alias("_s"))
    last = entries.groupBy("run_id").agg(F.max(F.struct("seq", F.coalesce("_s", F.lit("")).alias("_s")))["_s"].alias("_s"))
    return last.filter("_s = 'committed'").select("run_id")


def watermarks(done: DataFrame) -> DataFrame:
    """(doc_id, peer, watermark): the end of the first covered period of each writer, if it begins at its first id.

    Counters are dense and only grow, so they are the commit sequence of a writer: everything below the watermark is
    done for certain, whatever the holes above it. ``done`` holds disjoint maximal periods.
    """
    return done.filter("lo <= 0 and hi > 0").select("doc_id", "peer", F.col("hi").alias("watermark"))


def pending(changes: DataFrame, runs: DataFrame, run_spans: DataFrame, upper: int | None = None) -> DataFrame:
    """(doc_id, peer, counter): the delivered changes with at least one op id that no lasting run worked through.

    ``upper`` is the greatest ``arrival`` that may be seen; without one all of ``changes`` is, as when a ``Ledger`` has
    fixed it. Changes that end at or below their writer's watermark are done; those above are held against the periods
    that runs covered beyond it. A change delivered several times is one row; its longest delivery counts. Rows with a
    null in an id are no changes, nor are those without ids.
    """
    fixed = changes if upper is None else changes.filter(F.col("arrival") <= F.lit(upper))
    kept = run_spans.join(lasting_runs(runs), "run_id", "left_semi").select("doc_id", "peer", F.col("start_counter").alias("lo"), F.col("end_counter").alias("hi"))
    done = cut(periods(kept, ["doc_id", "peer"]), "done")  # read for the watermarks and for what lies beyond them
    asked = fixed.select("doc_id", "peer", F.col("counter").alias("lo"), F.col("end_counter").alias("hi"))
    asked = asked.groupBy("doc_id", "peer", "lo").agg(F.max("hi").alias("hi"))
    marks = watermarks(done)
    above = asked.join(marks, ["doc_id", "peer"], "left").filter("watermark is null or hi > watermark or lo < 0").drop("watermark")
    return uncovered(cut(above, "above"), done, ["doc_id", "peer"]).select("doc_id", "peer", F.col("lo").alias("counter"))


def take_pending(ledger: "Ledger", changes: DataFrame, runs: DataFrame, run_spans: DataFrame, crash: str | None = None) -> int | None:
    """One run of an import: takes up what arrived since the last one and is ``pending``, and what earlier runs of
    ``ledger`` took up is not taken up again if it was only delivered once more. Returns the new watermark."""
    before = ledger.output()

    def job(fresh: DataFrame) -> DataFrame:
        todo = pending(fresh, runs, run_spans)
        return todo if before is None else todo.join(before, ["doc_id", "peer", "counter"], "left_anti")

    return ledger.run(changes, "arrival", job, crash)


class Crash(RuntimeError):
    """What tests make a run die of."""


class Ledger:
    """The committed runs of one job over one growing table, in a folder of any file system Spark can write.

    A run reads the rows with watermark < seq <= upper, writes its output to a folder of its own and then creates the
    manifest of its number. Creating that file is the commit: it names the output and carries the watermark, so both
    become visible at once or not at all, and of two runs that started from one watermark only the first commits. A
    run that dies before leaves a folder that no manifest names; the next run starts from the old watermark. Sequence
    numbers must be unique and only grow; rows with a null one are never processed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """Driver-side: one short line per committed run, not per record."""
        at = self._path(f"{self.folder}/_commits")
        if not self._fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._read(f"{self.folder}/_commits/{n}")) for n in names]

    def _read(self, file: str) -> str:
        stream = self._fs.open(self._path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def watermark(self) -> int | None:
        done = self.manifests()
        return done[-1]["watermark"] if done else None

    def run(self, source: DataFrame, seq: str, job: Callable[[DataFrame], DataFrame], crash: str | None = None) -> int | None:
        """Runs ``job`` over what is new; returns the new watermark, or None if nothing is. ``crash`` is for tests: it
        fails before ('output') or after ('commit') the output is written, always ahead of the manifest."""
        done = self.manifests()
        low, number = (done[-1]["watermark"] if done else None), len(done)
        fresh = source if low is None else source.filter(F.col(seq) > F.lit(low))
        upper = fresh.agg(F.max(seq)).first()[0]
        if upper is None:
            return None
        if crash == "output":
            raise Crash("crash before the output")
        out = f"{self.folder}/data/{number:010d}-{uuid.uuid4().hex}"
        job(fresh.filter(F.col(seq) <= F.lit(upper))).write.parquet(out)
        if crash == "commit":
            raise Crash("crash before the commit")
        self.commit(number, {"output": out, "from": low, "watermark": upper})
        return upper

    def commit(self, number: int, manifest: dict) -> None:
        """The manifest is written aside and renamed; a rename never replaces a file, so a number is taken once."""
        aside = self._path(f"{self.folder}/_pending/{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        commits = self._path(f"{self.folder}/_commits")
        self._fs.mkdirs(commits)
        target = self._path(f"{self.folder}/_commits/{number:010d}.json")
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            raise RuntimeError(f"run {number} was committed by another writer")

    def output(self) -> DataFrame | None:
        """All committed output; None before the first commit."""
        done = self.manifests()
        return self.spark.read.parquet(*[m["output"] for m in done]) if done else None
