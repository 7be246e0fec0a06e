"""The chain with history, frameworks, broken projects and a cut."""

import pytest
from pyspark.sql import functions as F

from forgelens.plans import handlers, jobs
from forgelens.sources import trees

from .test_handlers import write

def now():
    return F.lit("2024-06-01").cast("timestamp")


def commit(folder, n, date, subject):
    return "\x1f".join([str(folder), f"{n:040x}", "a", date, subject])


@pytest.fixture
def code(tmp_path):
    for name, dependency in (("one", "fastapi==0.1"), ("two", "pandas"), ("three", "django")):
        write(tmp_path / "code", name, dependency)
    (tmp_path / "code" / "one" / ".git").mkdir()
    (tmp_path / "code" / "one" / ".git" / "HEAD").write_text("ref: refs/heads/dev\n")
    return tmp_path / "code"


def test_history_and_frameworks(spark, tmp_path, code):
    """Health and status follow from the log; a framework of a manifest is a capability."""
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "all.log").write_text("\n".join([commit(code / "one", i, f"2024-05-{i + 1:02d}T00:00:00Z", f"s{i}") for i in range(20)] + [commit(code / "two", i, f"2021-01-{i + 1:02d}T00:00:00Z", "old") for i in range(9)] + ["no commit"]))
    store = handlers.Store(spark, f"file://{tmp_path}/store")
    runner = jobs.Runner(spark, f"file://{tmp_path}/jobs", handlers.handlers(store, now(), [f"file://{code}"]))
    runner.run("scan", {"chain": True, "commit_log": f"file://{tmp_path}/log"})
    assert {r.type: r.status for r in jobs.fold(runner.events()).collect()} == {"scan": "completed", "index": "completed", "insight": "completed"}
    rows = {r.name: r for r in store.read("projects").collect()}
    one, two, three = rows["one"], rows["two"], rows["three"]
    assert (one.git_commits, one.recent_commits, one.contributors, one.branch, one.recent_subjects[:2]) == (20, 20, 1, "dev", ["s19", "s18"])
    assert two.git_commits == 9 and three.git_commits == 0 and three.recent_subjects == [] and one.has_git and not two.has_git
    assert one.last_commit_at.startswith("2024-05-20") and one.health_score > three.health_score
    assert one.tags == ["FastAPI", "Redis"] and three.tags == ["Django", "Redis"]
    edges = {(r.source_id, r.target_id): r.evidence for r in store.read("relations").where("relation_type = 'implements'").collect()}
    assert {e for (p, c), e in edges.items() for e in [c] if p == one.id} >= {"cap_web_api", "cap_caching"}
    assert [(r.stage, r.path) for r in store.read("problems").collect()] == [("log", "all.log")]


def test_one_broken_project_among_three(spark, tmp_path, code, monkeypatch):
    """Two rows and one error, whether a folder of it cannot be read or, where that is asked
    for, its manifest is broken; and the cut is told of."""
    (code / "two" / "pyproject.toml").write_text("[project\nname =")
    store = handlers.Store(spark, f"file://{tmp_path}/store")
    problems = handlers.scan(store, [f"file://{code}"], now(), strict=True).collect()
    assert [(r.stage, r.path) for r in problems] == [("manifest", "two")] and problems[0].error.startswith("pyproject.toml: ")
    assert {r.name for r in store.read("projects").collect()} == {"one", "three"}
    problems = handlers.scan(store, [f"file://{code}"], now()).collect()  # else it has no dependencies of it
    assert [(r.stage, r.path) for r in problems] == [("manifest", "two")] and store.read("projects").count() == 3

    real = trees.listing
    failed = lambda spark, root: real(spark, root).withColumn("error", F.when(F.col("rel_path") == "one/src/app.py", "PermissionError"))
    monkeypatch.setattr(handlers.trees, "listing", failed)
    other = handlers.Store(spark, f"file://{tmp_path}/other")
    problems = {(r.stage, r.path) for r in handlers.scan(other, [f"file://{code}"], now()).collect()}
    assert problems == {("read", "one/src/app.py"), ("manifest", "two")} and {r.name for r in other.read("projects").collect()} == {"two", "three"}
    monkeypatch.setattr(handlers.trees, "listing", real)
    cut = handlers.Store(spark, f"file://{tmp_path}/cut")
    problems = {(r.stage, r.path) for r in handlers.scan(cut, [f"file://{code}"], now(), most=1).collect()}
    assert problems == {("manifest", "two"), ("cut", "three"), ("cut", "two")} and cut.read("projects").count() == 1


def test_a_scan_of_the_stores_own_directories(spark, tmp_path, code):
    """Enabled directories alone are scanned, and know their numbers of projects."""
    import datetime

    from forgelens.plans.settings import ScanSettings

    write(tmp_path / "rest", "four", "pandas")
    store = handlers.Store(spark, f"file://{tmp_path}/store")
    kept, added = ScanSettings(store), datetime.datetime(2024, 1, 1)
    kept.add(f"{code}/", added)
    kept.add(str(tmp_path / "rest"), added)
    kept.enable(str(tmp_path / "rest"), False)
    runner = jobs.Runner(spark, f"file://{tmp_path}/jobs", handlers.handlers(store, now()))
    runner.run("scan", {})
    assert {r.name for r in store.read("projects").collect()} == {"one", "two", "three"}
    after = F.lit("2024-06-03").cast("timestamp")
    assert [(r.enabled, r.project_count, r.scanned) for r in kept.view(after).collect()] == [(True, 3, "2 d ago"), (False, None, None)]
    runner.run("scan", {"dirs": [f"file://{tmp_path}/rest"]})
    assert [(r.project_count, r.scanned) for r in kept.view(after).collect()] == [(3, "2 d ago"), (1, "2 d ago")]
