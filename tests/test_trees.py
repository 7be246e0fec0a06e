"""Source trees as a data source: what is read, what is pushed, what fails."""

import os

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from forgelens.sources import projects, trees


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        "app/package.json": "{}", "app/src/a.ts": "let x\n", "app/src/b.min.js": "x", "app/src/deep/er/c.py": "c = 1\n", "app/node_modules/x/i.js": "x", "app/.env": "KEY=1", "app/secrets.json": "{}",
        "app/api_token.py": "t = 1", "app/.git/HEAD": "ref: refs/heads/main\n", "app/.git/config": "c", "lib/Cargo.toml": "[package]", "lib/logo.png": "png", "README.md": "# r", "lib/big.py": "x" * 5000,
    }.items():
        file = tmp_path / "t" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    os.symlink(tmp_path / "t", tmp_path / "t" / "app" / "loop")
    return str(tmp_path / "t")


def rows(reader):
    return [dict(zip(trees._NAMES, r, strict=True)) for p in reader.partitions() for r in reader._rows(p)]


def test_as_a_walk(spark, tree):
    got = {r.rel_path: r for r in trees.listing(spark, f"file://{tree}", bytes=4000, partitions=3).collect()}
    want = {"app/package.json", "app/src/a.ts", "app/src/b.min.js", "app/src/deep/er/c.py", "app/api_token.py", "app/.git/HEAD", "lib/Cargo.toml", "lib/logo.png", "README.md", "lib/big.py"}
    assert set(got) == want
    content = {p: r.content for p, r in got.items() if r.content is not None}
    assert set(content) == {"app/package.json", "app/src/a.ts", "app/src/deep/er/c.py", "app/.git/HEAD", "lib/Cargo.toml", "README.md"}
    assert bytes(content["app/src/a.ts"]) == b"let x\n" and got["lib/big.py"].length == 5000 and got["app/src/a.ts"].modified.timestamp() == pytest.approx(os.stat(f"{tree}/app/src/a.ts").st_mtime, abs=1e-3)
    none = trees.listing(spark, tree, content=False)
    assert none.where("content IS NOT NULL").count() == 0 and none.count() == len(want)


def test_the_same_projects_and_counts_as_from_any_store(spark, tree):
    """Language counts as those of the reader of binary files, which goes round in links."""
    os.unlink(f"{tree}/app/loop")
    of = lambda files: projects.assign(files, projects.project_roots(files, spark))
    count = lambda files: {(r.project_id, r.name): (r.loc, r.files) for r in projects.language_stats(of(files)).collect()}
    got = count(trees.listing(spark, tree).where("error IS NULL"))
    want = count(projects.listing(spark, f"file://{tree}"))
    assert got == want and got[("app", "TypeScript")] == (1, 1)


def test_bounds_of_counting(spark, tree):
    files = projects.assign(f := trees.listing(spark, tree), projects.project_roots(f, spark))
    names = lambda **k: {r.name: r.files for r in projects.language_stats(files, **k).where("project_id = 'app'").collect()}
    assert names()["Python"] == 1 and "Python" not in names(depth=1) and sum(names(count=1).values()) == 1


def test_filters_are_pushed_before_contents_are_read(spark, tree, monkeypatch):
    read = []
    monkeypatch.setattr(trees, "read", lambda path: read.append(os.path.basename(path)) or b"")
    reader = trees.TreeReader({"path": tree})
    filters = [ds.StringEndsWith(("name",), ".py"), ds.LessThanOrEqual(("length",), 100), ds.Not(ds.StringStartsWith(("rel_path",), "lib/")), ds.EqualTo(("content",), b"x")]
    left = list(reader.pushFilters(filters))
    assert left == [filters[3]]
    assert sorted(r["rel_path"] for r in rows(reader)) == ["app/api_token.py", "app/src/deep/er/c.py"] and read == ["c.py"]
    df = trees.listing(spark, tree).where(F.col("name").isin("a.ts", "package.json") & (F.col("length") < 100))
    assert {r.name for r in df.collect()} == {"a.ts", "package.json"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if x.lstrip(" +-:*(1234567890)").startswith("Filter ")], plan


def test_unreadable_folders_are_rows(spark, tree, monkeypatch):
    real = os.scandir

    def scan(path):
        if path.endswith(("src/deep", "lib")):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", scan)
    got = rows(trees.TreeReader({"path": tree, "partitions": "2"}))
    assert sorted((r["rel_path"], r["error"]) for r in got if r["error"]) == [("app/src/deep", "PermissionError: Permission denied"), ("lib", "PermissionError: Permission denied")]
    assert {r["rel_path"] for r in got if not r["error"]} == {"app/package.json", "app/src/a.ts", "app/src/b.min.js", "app/api_token.py", "app/.git/HEAD", "README.md"}
    errors = spark.createDataFrame([("app/src/deep", "no"), ("other", "no"), ("", "no")], "rel_path string, error string")
    roots = spark.createDataFrame([("app",), ("lib",)], "dir string")
    assert [(r.dir, r.rel_path) for r in trees.failed_projects(errors, roots).collect()] == [("app", "app/src/deep")]


def test_depth_and_count_are_options(tree):
    got = {r["rel_path"] for r in rows(trees.TreeReader({"path": tree, "depth": "2", "partitions": "1"}))}
    assert "app/src/a.ts" in got and "app/src/deep/er/c.py" not in got
    few = rows(trees.TreeReader({"path": tree, "files": "2", "partitions": "1"}))
    assert [r["error"] for r in few if r["error"]] == ["more than 2 files; the others were left out"]


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception, match="no folder"):
        trees.listing(spark, str(tmp_path / "none")).collect()
