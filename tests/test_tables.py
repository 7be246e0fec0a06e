"""Versions, migrations, leases, the event log and table sizes."""

import threading

import pytest
from pyspark.sql import functions as F

from forgelens.plans import jobs, schema
from forgelens.sources import tables


@pytest.fixture
def store(spark, tmp_path):
    return tables.Store(spark, f"file://{tmp_path}/store")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id int")


def test_versions(spark, store):
    assert store.version() == 0 and not store.has("a")
    assert store.commit({"a": numbers(spark, 1), "b": numbers(spark, 7)}) == 1
    # A table that is read while it is replaced, and an older version.
    assert ids(store.replace("a", store.read("a").unionByName(numbers(spark, 2)))) == [1, 2]
    assert ids(store.read("a", 1)) == [1] and ids(store.read("b")) == [7]
    assert [tuple(r) for r in store.history().orderBy("version").collect()] == [(1, 0, ["a", "b"]), (2, 0, ["a"])]
    store.replace("a", numbers(spark, 3))
    assert store.vacuum(keep=1) == 2 and ids(store.read("a")) == [3] and ids(store.read("b")) == [7]


def test_a_failure_between_the_steps_leaves_the_version_before(spark, store, monkeypatch):
    store.commit({"a": numbers(spark, 1), "b": numbers(spark, 1)})
    broken = numbers(spark, 1).select(F.raise_error(F.lit("no")).cast("int").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.commit({"a": numbers(spark, 2), "b": broken})
    monkeypatch.setattr(tables.Log, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.commit({"a": numbers(spark, 3)})
    assert store.version() == 1 and ids(store.read("a")) == [1] and ids(store.read("b")) == [1]


def test_conflicts(spark, store):
    store.commit({"a": numbers(spark, 1), "b": numbers(spark, 1)})
    store.commit({"b": numbers(spark, 2)})
    # Made from version 1: another table changed meanwhile, which does not matter, unless it was read.
    assert store.commit({"a": numbers(spark, 5)}, at=1) == 3
    assert ids(store.read("a")) == [5] and ids(store.read("b")) == [2]
    for changed, reads in (({"a": numbers(spark, 6)}, ()), ({"c": numbers(spark, 6)}, ["b"])):
        with pytest.raises(tables.Conflict):
            store.commit(changed, reads=reads, at=1)
    assert store.version() == 3 and not store.has("c")


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    log = tables.Log(spark, f"file://{tmp_path}/log")
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append((log.append(1, {"i": i}), i))) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (winner,) = [i for ok, i in got if ok]
    assert log.read(1) == {"i": winner} and log.numbers() == [1]


def test_migrations_run_once_and_fill_what_was_there(spark, store):
    steps = schema.STEPS
    assert tables.migrate(store, steps[:1])["applied"] == [1]
    insights = spark.createDataFrame([("i1", "Twice built", "two queues", '["queue","retry"]', "duplicate_capability", '[{"label":"a.py","target":"p:a.py"}]', 0.9, None, "2024-01-01"), ("i2", None, None, "broken", None, None, 0.5, None, None)], schema.FIRST["insights"])
    audit = spark.createDataFrame([(1, "cloud:x", "p", "s", None), (2, "-", "p", "s", None), (3, None, "p", "s", None)], schema.FIRST["audit_log"])
    store.commit({"insights": insights, "audit_log": audit})
    done = schema.upgrade(store)
    assert done == {"from": 1, "to": 3, "applied": [2, 3]} and store.snapshot()["schema"] == 3
    grams = {r.gram for r in store.read("insights_postings").where("id = 'i1'").collect()}
    assert {"que", "ret", "a.p", "twi"} <= grams and not any('"' in g or "[" in g or "p:a" in g for g in grams)
    assert {r.seq: r.ok for r in store.read("audit_log").collect()} == {1: True, 2: None, 3: None}
    before = store.version()
    assert schema.upgrade(store)["applied"] == [] and store.version() == before
    fresh = tables.Store(spark, store.root + "-new")
    assert schema.upgrade(fresh)["applied"] == [1, 2, 3] and fresh.version() == 1 and set(schema.FIRST) < set(fresh.snapshot()["tables"])


def test_a_broken_migration_changes_nothing(spark, store):
    store.commit({"a": numbers(spark, 1)})
    good = lambda spark, t: {"a": t["a"].withColumn("x", F.lit(1))}

    def bad(spark, t):
        assert "x" in t["a"].columns  # it sees what the step before made
        raise ValueError("half way")

    with pytest.raises(ValueError):
        tables.migrate(store, [good, bad])
    assert store.version() == 1 and store.read("a").columns == ["id"] and store.snapshot()["schema"] == 0


def test_of_two_migrations_at_once_one_is_applied(spark, store):
    store.commit({"a": numbers(spark, 1)})
    seen = []

    def slow(spark, t):
        if not seen:  # the other one comes first
            seen.append(1)
            assert tables.migrate(store, [slow])["applied"] == [1]
        return {"a": t["a"].withColumn("x", F.lit(1))}

    assert tables.migrate(store, [slow]) == {"from": 1, "to": 1, "applied": []}
    assert store.version() == 2


def test_statistics(spark, store, tmp_path):
    store.commit({"a": numbers(spark, 1, 2, 3), "none": numbers(spark)})
    paths = {n: f"{store.root}/{f}" for n, f in store.snapshot()["tables"].items()}
    got = {r.table: (r.n, r.bytes) for r in tables.statistics(paths, spark).collect()}
    size = sum(f.stat().st_size for f in (tmp_path / "store" / "a").rglob("*.parquet"))
    assert got["none"] == (0, 0) and got["a"][0] == 3 and 0 < got["a"][1] <= size
    assert "ReadSchema: struct<>" in tables.statistics(paths, spark)._jdf.queryExecution().toString()


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


def test_runners_that_race(spark, tmp_path):
    """Each starts while the other's job runs; then two that look at the same moment."""
    path, met = f"file://{tmp_path}/jobs", []

    def work(options, report):
        other = jobs.Runner(spark, path, {"scan": work, "index": lambda o, r: None})
        with pytest.raises(jobs.Busy):
            other.run("scan")
        met.append(other.run("index"))  # another type is free

    runner = jobs.Runner(spark, path, {"scan": work})
    runner.run("scan")
    assert len(met) == 1
    states = {r.type: r.status for r in jobs.fold(runner.events()).collect()}
    assert states == {"scan": "completed", "index": "completed"}
    leases = [jobs.Lease(spark, f"{path}/both", "scan") for _ in range(8)]
    got, barrier = [], threading.Barrier(8)

    def ask(lease):
        barrier.wait()
        try:
            lease.take(lease.owner)
            got.append(lease.owner)
        except jobs.Busy:
            pass

    threads = [threading.Thread(target=ask, args=(x,)) for x in leases]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 1 and leases[0].holder()["owner"] == got[0]


def test_leases_run_out(spark, tmp_path):
    clock = Clock()
    path = f"file://{tmp_path}/jobs"
    dead = jobs.Runner(spark, path, {}, seconds=60, clock=clock)
    lease = dead.submit("scan", "scan-dead")
    dead.append("scan-dead", "scan", "running", 0.0)
    clock.now += 30
    lease.renew()
    with pytest.raises(jobs.Busy):
        jobs.Runner(spark, path, {"scan": lambda o, r: None}, seconds=60, clock=clock).run("scan")
    clock.now += 61
    (ran,) = jobs.Runner(spark, path, {"scan": lambda o, r: None}, seconds=60, clock=clock).run("scan")
    states = {r.job_id: (r.status, r.error) for r in jobs.fold(dead.events()).collect()}
    assert states == {"scan-dead": ("failed", "interrupted"), ran: ("completed", None)}
    with pytest.raises(jobs.Busy):
        lease.renew()


def test_progress_is_thinned_and_the_log_compacts_itself(spark, tmp_path):
    clock = Clock()

    def work(options, report):
        for i in range(100):
            clock.now += 0.1
            report(i / 100, "step", i, 100)
        report(1.0)

    runner = jobs.Runner(spark, f"file://{tmp_path}/jobs", {"scan": work}, clock=clock)
    runner.log.many = 4
    for _ in range(3):
        runner.run("scan")
    assert len(runner.log._files()) < 4
    per_job = runner.events().groupBy("job_id").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.count_distinct("seq").alias("seqs")).collect()
    assert len(per_job) == 3 and all(30 < r.n < 45 and r.total == 100 and r.seqs == r.n for r in per_job)
    assert {(r.status, r.progress) for r in jobs.fold(runner.events()).collect()} == {("completed", 1.0)}


def test_compaction_loses_nothing_that_comes_meanwhile(spark, tmp_path):
    log = jobs.Events(spark, f"file://{tmp_path}/events", many=100)
    row = lambda i: (f"j{i}", i, "scan", "running", 0.0, None, None, None, None, 1.0 * i)
    for i in range(3):
        log.add([row(i)])
    files = log._files()
    other = jobs.Events(spark, f"file://{tmp_path}/events")
    monkey, done = log._files, []

    def late():
        if not done:  # a file comes between the listing and the merge
            done.append(1)
            other.add([row(9)])
            return files
        return monkey()

    log._files = late
    assert log.compact()
    assert sorted(r.seq for r in other.read().collect()) == [0, 1, 2, 9] and len(other._files()) == 2


def test_cancel_all(spark, tmp_path):
    def work(options, report):
        assert len(runner.cancel_all()) == 1
        report(0.5)

    runner = jobs.Runner(spark, f"file://{tmp_path}/jobs", {"scan": work})
    runner.run("scan")
    assert {r.status for r in jobs.fold(runner.events()).collect()} == {"cancelled"} and runner.cancel_all() == []
