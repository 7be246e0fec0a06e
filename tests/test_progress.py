"""The stream of progress: thinned, with heartbeats, and no state of jobs that have ended."""

import time

import pytest
from pyspark.sql import functions as F

from forgelens.plans import jobs
from forgelens.streaming import progress


class Feed:
    def __init__(self, spark, path):
        self.spark, self.path, self.seq = spark, path, 0
        self.send([])

    def send(self, rows):
        """Events (job, status, progress) in one file."""
        made = []
        for job, status, value in rows:
            self.seq += 1
            made.append((job, self.seq, "scan", status, value, None, None, None, None, None))
        self.spark.createDataFrame(made, jobs.EVENTS).coalesce(1).write.mode("append").parquet(self.path)


@pytest.fixture
def served(spark, tmp_path):
    feed, got, queries = Feed(spark, str(tmp_path / "in")), [], []

    def start(**limits):
        stream = spark.readStream.schema(jobs.EVENTS).parquet(feed.path)
        queries.append(progress.serve(stream, lambda frame, _: got.extend(frame.to_dict("records")), str(tmp_path / "check"), 0.05, **limits))
        return queries[-1]

    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield feed, got, start
    [q.stop() for q in queries]
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end
        time.sleep(0.05)


def test_thinned_with_heartbeats(spark, served):
    feed, got, start = served
    query = start(throttle=1500, heartbeat=4000, remember=3_600_000)
    feed.send([("a", "queued", 0.0), ("b", "running", 0.5)])
    until(lambda: len(got) >= 2)
    for i in range(1, 9):
        feed.send([("a", None, i / 10)])
    until(lambda: any(r["job_id"] == "a" and r["progress"] == 0.8 for r in got))
    until(lambda: any(r["kind"] == "heartbeat" and r["job_id"] == "b" for r in got))
    feed.send([("a", "completed", None)])
    feed.send([("a", "failed", 0.1), ("b", "cancelled", None)])
    until(lambda: {r["job_id"] for r in got if r["status"] in ("completed", "cancelled")} == {"a", "b"})
    ended = len(got)
    feed.send([("a", "running", 0.2)])
    time.sleep(5)
    assert query.exception() is None and len(got) == ended  # no heartbeat, and no change, after the end
    of_a = [r for r in got if r["job_id"] == "a"]
    assert [r["status"] for r in of_a][-1] == "completed" and of_a[-1]["progress"] == 1.0 and len(of_a) < 9
    open_ones = [r for r in of_a if r["status"] != "completed"]
    assert all(y["at"] - x["at"] >= 1500 for x, y in zip(open_ones, open_ones[1:], strict=False))
    beats = [r for r in got if r["job_id"] == "b"]
    assert [r["kind"] for r in beats[:2]] == ["change", "heartbeat"] and beats[1]["at"] - beats[0]["at"] >= 4000 and beats[1]["progress"] == 0.5


def test_ended_jobs_are_forgotten(spark, served):
    """After a while the mark of an ended job goes, too: its id may begin again."""
    feed, got, start = served
    start(throttle=10, heartbeat=60_000, remember=1500)
    feed.send([("a", "completed", None)])
    until(lambda: len(got) == 1)
    feed.send([("a", "running", 0.3)])
    time.sleep(4)
    assert len(got) == 1
    feed.send([("a", "running", 0.4)])
    until(lambda: len(got) == 2)
    assert (got[1]["status"], got[1]["progress"]) == ("running", 0.4)


def test_step_is_the_fold(spark):
    rows = [("j", i, s, p) for i, (s, p) in enumerate([("queued", None), (None, 0.4), (None, 7.0), ("failed", 0.2), ("completed", None)])]
    events = spark.createDataFrame([(j, i, "scan", s, p, None, None, None, None, None) for j, i, s, p in rows], jobs.EVENTS)
    state = jobs.fold(events).select("status", F.round("progress", 6)).first()
    assert tuple(state) == progress.step(None, [r[1:] for r in rows])[:2] == ("failed", 0.2)
