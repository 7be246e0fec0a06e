"""Commit logs: lines, counts, subjects, and lines that are no commits."""

import pytest
from pyspark.sql import functions as F

from forgelens.sources import history, projects

def now():
    return F.lit("2024-06-01").cast("timestamp")


def line(folder, n, author, date, subject):
    return "\x1f".join([folder, f"{n:040x}", author, date, subject])


@pytest.fixture
def logs(tmp_path):
    one = [line("/w/one/", i, "a" if i % 2 else "b", f"2024-05-{i + 1:02d}T10:00:00+02:00", f"step {i}") for i in range(25)] + ["", "not a commit", line("/w/one", 1, "a", "soon", "x")]
    two = [line("/w/two", 1, "c", "2020-01-01T00:00:00Z", "old\x1fwith a separator"), line("/w/two", 2, "c", "2024-04-01T00:00:00Z", "  "), "\x1f".join(["/w/two", "xyz", "c", "2024-01-01", "s"])]
    (tmp_path / "one.log").write_text("\n".join(one))
    (tmp_path / "two.log").write_text("\n".join([*two, one[3]]))
    return f"file://{tmp_path}"


def test_facts_and_subjects(spark, logs):
    log, rejected = history.read_log(spark, logs)
    rows = {r.project_id: r for r in history.history(log, now(), subjects=3).collect()}
    one, two = rows["/w/one"], rows["/w/two"]
    assert (one.commits, one.recent, one.authors, str(one.last_commit)) == (25, 25, 2, "2024-05-25 08:00:00") and one.subjects == ["step 24", "step 23", "step 22"]
    assert (two.commits, two.recent, two.authors, str(two.first_commit)) == (2, 1, 1, "2020-01-01 00:00:00") and two.subjects == ["old\x1fwith a separator"]
    assert sorted((r.file, r.error) for r in rejected.collect()) == [("one.log", "fewer than five fields"), ("one.log", "no date"), ("two.log", "no commit id")]


def test_at_the_cap_the_first_commit_is_not_known(spark, logs):
    log, _ = history.read_log(spark, logs)
    rows = {r.project_id: r for r in history.history(log, now(), subjects=1000, most=10).collect()}
    assert rows["/w/one"].commits == 10 and rows["/w/one"].first_commit is None and rows["/w/two"].first_commit is not None and len(rows["/w/one"].subjects) == 25


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.log").write_text("\n\n")
    log, rejected = history.read_log(spark, f"file://{tmp_path}")
    assert history.history(log, now()).count() == 0 == rejected.count()


def test_branches(spark):
    heads = {"ref: refs/heads/main\n": "main", "ref: refs/heads/feature/a.b\r\n": "feature/a.b", "f" * 40: None, "": None, "ref: refs/tags/x": None, "ref: refs/heads/\n": None}
    df = spark.createDataFrame([(h,) for h in heads], "h string").select("h", projects.branch(F.col("h")).alias("b"))
    assert {r.h: r.b for r in df.collect()} == heads
