"""Jobs: an append-only log of events folded to states, leases, and the chain of stages."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.enums import TERMINAL
from ..sources.tables import Log

CHAIN = ["scan", "index", "insight"]
EVENTS = "job_id string, seq long, type string, status string, progress double, stage string, processed long, total long, error string, at timestamp"
#: Seconds for which a lease holds unless it is renewed, and least seconds between two
#: progress events of a job that are kept; 100 % and ends are always kept.
LEASE, INTERVAL = 300.0, 0.25
#: From this many files on, the event log is written into one.
MANY_FILES = 64


def fold(events: DataFrame) -> DataFrame:
    """The state of each job. The first terminal event is final: later ones do not count.
    Progress is clamped to 0..1; a queued job that moves is running; progress alone ends
    nothing. Aggregates alone, so map sides combine and a hot job is no hot task."""
    terminal = F.col("status").isin(TERMINAL)
    ends = events.where(terminal).groupBy("job_id").agg(F.min("seq").alias("_end"))
    counted = events.join(ends, "job_id", "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    state = counted.groupBy("job_id").agg(*[last(c) for c in ("type", "status", "progress", "stage", "processed", "total", "error")], F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    moved = F.coalesce(F.least(F.greatest("progress", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    done = F.when(F.col("status") == "completed", F.lit(1.0)).otherwise(moved)
    return state.withColumn("progress", done).withColumn("status", F.when((F.coalesce("status", F.lit("queued")) == "queued") & (F.col("progress") > 0), "running").otherwise(F.coalesce("status", F.lit("queued"))))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running"))


def overall(jobs: DataFrame) -> DataFrame:
    """progress, processed, total of active jobs; null where there is none, or no total."""
    total = F.nullif(F.coalesce(F.sum("total"), F.lit(0)), F.lit(0))
    return active(jobs).agg(F.avg("progress").alias("progress"), F.when(total.isNotNull(), F.sum("processed")).alias("processed"), total.alias("total"))


def view(jobs: DataFrame) -> DataFrame:
    counter = F.when(F.col("total") > 0, F.concat_ws("/", F.coalesce("processed", F.lit(0)).cast("string"), F.col("total").cast("string")))
    return jobs.withColumns({"percent": F.round(F.col("progress") * 100).cast("int"), "counter": counter, "cancellable": ~F.col("status").isin(TERMINAL)})


def purge(jobs: DataFrame, keep: int) -> DataFrame:
    """Without finished jobs but for the newest ``keep``."""
    finished = jobs.where(F.col("status").isin(TERMINAL))
    old = finished.select("job_id").exceptAll(finished.orderBy(F.col("updated_at").desc(), F.col("job_id").desc()).limit(keep).select("job_id"))
    return jobs.join(old, "job_id", "left_anti")


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """After a restart nothing runs: active jobs have failed."""
    stale = F.col("status").isin("queued", "running")
    return jobs.withColumns({"error": F.when(stale, "interrupted").otherwise(F.col("error")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


class Busy(ValueError):
    """A job of the type is queued or running."""


class Lease:
    """The right to run jobs of one type: of several that ask at once one gets it, as each
    writes the same next number of a log. It ends when it is given back, or when its time is
    over without being renewed: then its owner is taken to have died."""

    def __init__(self, spark: SparkSession, path: str, kind: str, seconds: float = LEASE, clock: Callable[[], float] = time.time):
        self.log, self.kind, self.seconds, self.clock = Log(spark, f"{path}/{kind}"), kind, seconds, clock
        self.owner, self.n = f"{socket.gethostname()}-{os.getpid()}-{uuid.uuid4().hex[:8]}", 0

    def holder(self) -> dict | None:
        """Who has it now."""
        n = self.log.last()
        entry = self.log.read(n) if n else None
        return entry if entry and entry["owner"] and entry["until"] > self.clock() else None

    def take(self, job_id: str) -> str | None:
        """Takes the lease for a job, or raises Busy. The job whose lease ran out, if any."""
        n = self.log.last()
        entry = self.log.read(n) if n else {"owner": None, "job_id": None, "until": 0.0}
        if entry["owner"] and entry["until"] > self.clock():
            raise Busy(f"{self.kind}: {entry['job_id']} runs")
        if not self.log.append(n + 1, {"owner": self.owner, "job_id": job_id, "until": self.clock() + self.seconds}):
            raise Busy(f"{self.kind}: another one was faster")
        self.n = n + 1
        return entry["job_id"] if entry["owner"] else None

    def _next(self, owner: str | None) -> bool:
        entry = self.log.read(self.n)
        ours = self.log.append(self.n + 1, entry | {"owner": owner, "until": self.clock() + self.seconds})
        self.n += ours
        return ours

    def renew(self) -> None:
        """Holds it for longer, once a third of its time is over. Lost to another: Busy."""
        if self.n and self.log.read(self.n)["until"] - self.clock() < self.seconds * 2 / 3 and not self._next(self.owner):
            self.n = 0
            raise Busy(f"{self.kind}: the lease ran out and another one has it")

    def give_back(self) -> None:
        if self.n:
            self._next(None)
            self.n = 0


class Events:
    """The log of events: Parquet files in a folder. Events are gathered and written when a
    job changes its status, or after a while; many files are written into one."""

    def __init__(self, spark: SparkSession, path: str, many: int = MANY_FILES):
        self.spark, self.path, self.many, self.waiting = spark, path.rstrip("/"), many, []
        self.merged = Log(spark, f"{self.path}/_merged")

    def _files(self) -> list[str]:
        """The files that count: those that no merged one stands for."""
        path, fs = self.merged.jvm.org.apache.hadoop.fs.Path, self.merged.fs
        root = path(self.path)
        if not fs.exists(root):
            return []
        names = {s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("e-")}
        gone = {f for n in self.merged.numbers() for f in self.merged.read(n)["files"]}
        wanted = {self.merged.read(n)["into"] for n in self.merged.numbers()}
        return sorted(n for n in names - gone if not n.startswith("e-merged") or n in wanted)

    def read(self) -> DataFrame:
        files = self._files()
        return self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], EVENTS)

    def add(self, rows: Sequence[tuple], flush: bool = True) -> None:
        """``rows`` as EVENTS has them, with seconds since 1970 in place of the timestamp."""
        self.waiting += rows
        if flush and self.waiting:
            some = self.spark.createDataFrame(self.waiting, EVENTS.replace("at timestamp", "at double")).withColumn("at", F.timestamp_seconds("at"))
            some.coalesce(1).write.parquet(f"{self.path}/e-{uuid.uuid4().hex}")
            self.waiting = []
            if len(self._files()) >= self.many:
                self.compact()

    def compact(self) -> bool:
        """Writes all files that count into one, and then says so in one log entry: readers
        see the old files or the new one. Files that come meanwhile stay as they are. Whether
        it was done: of several at once one does it."""
        files, n, into = self._files(), self.merged.last(), f"e-merged-{uuid.uuid4().hex}"
        if len(files) < 2:
            return False
        self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/{f}" for f in files]).coalesce(1).write.parquet(f"{self.path}/{into}")
        return self.merged.append(n + 1, {"files": files, "into": into})


class Runner:
    """Runs stages one after another and appends their events to a table.

    A job runs under its type's lease, so that runners anywhere start one at a time; a job
    whose lease ran out is failed by the next of its type. A stage that raises fails its job,
    and no stage follows; a chained stage follows only success. Cancelling a job cancels its
    Spark job group."""

    def __init__(self, spark: SparkSession, path: str, handlers: dict[str, Callable[[dict, Callable], None]], seconds: float = LEASE, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.handlers, self.seconds, self.clock = spark, path.rstrip("/"), handlers, seconds, clock
        self.log = Events(spark, f"{self.path}/events")
        self.running: dict[str, str] = {}
        self.seq = self._last()  # a log goes on where it ended

    def _last(self) -> int:
        return self.events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def events(self) -> DataFrame:
        return self.log.read()

    def append(self, job_id: str, kind: str, status: str | None = None, progress: float | None = None, error: str | None = None, stage: str | None = None, processed: int | None = None, total: int | None = None, flush: bool = True) -> None:
        # Numbers of events order those of one job, which one runner writes: time, and never back.
        self.seq = max(self.seq + 1, int(self.clock() * 1000))
        self.log.add([(job_id, self.seq, kind, status, progress, stage, processed, total, error, self.clock())], flush)

    def submit(self, kind: str, job_id: str) -> Lease:
        """The lease under which a job of the type may run, or Busy. Jobs of the type that the
        log has as active have died, if their lease ran out or nothing was heard of them for
        as long as one lasts; a younger one, of a writer without leases, is waited for."""
        lease = Lease(self.spark, f"{self.path}/leases", kind, self.seconds, self.clock)
        dead = lease.take(job_id)
        for row in active(fold(self.events())).where(F.col("type") == kind).select("job_id", F.unix_millis("updated_at").alias("ms")).toLocalIterator():
            if row["job_id"] != dead and row["ms"] / 1000 > self.clock() - self.seconds:
                lease.give_back()
                raise Busy(f"{kind}: {row['job_id']} runs")
            self.append(row["job_id"], kind, "failed", error="interrupted")
        return lease

    def run(self, kind: str, payload: str | dict = "{}") -> list[str]:
        """Ids of the jobs that ran."""
        options = json.loads(payload) if isinstance(payload, str) else payload
        ran = []
        while kind:
            job_id = f"{kind}-{uuid.uuid4().hex[:12]}"
            lease = self.submit(kind, job_id)
            ran.append(job_id)
            self.running[job_id] = kind
            self.append(job_id, kind, "running", 0.0)
            self.spark.sparkContext.setJobGroup(job_id, kind, True)
            written = [self.clock()]

            def report(progress: float, stage: str | None = None, processed: int | None = None, total: int | None = None) -> None:
                lease.renew()  # noqa: B023
                if progress >= 1 or self.clock() - written[0] >= INTERVAL:  # noqa: B023
                    written[0] = self.clock()  # noqa: B023
                    self.append(job_id, kind, None, progress, None, stage, processed, total, flush=progress >= 1)  # noqa: B023

            try:
                self.handlers[kind](options, report)
            except Exception as e:
                self.append(job_id, kind, "failed", error=str(e)[:500])
                break
            else:
                self.append(job_id, kind, "completed", 1.0)
            finally:
                del self.running[job_id]
                lease.give_back()
            at = CHAIN.index(kind) + 1 if kind in CHAIN else len(CHAIN)
            kind = CHAIN[at] if options.get("chain") and at < len(CHAIN) else ""
        return ran

    def cancel(self, job_id: str, kind: str) -> None:
        self.spark.sparkContext.cancelJobGroup(job_id)
        self.append(job_id, kind, "cancelled")

    def cancel_all(self) -> list[str]:
        """Before the end: cancels what this runner runs; the ids."""
        ids = list(self.running)
        for job_id in ids:
            self.cancel(job_id, self.running[job_id])
        return ids
