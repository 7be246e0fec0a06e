"""Scan, index and insight as one chain over projects on disk."""

import pytest
from pyspark.sql import functions as F

from forgelens.operators import relational
from forgelens.plans import handlers, jobs

NOW = "2030-01-01"
CODE = '"""Doc."""\n\n\ndef retry_queue(items: list) -> list:\n    """Retries what failed."""\n    out = []\n    for x in items:\n        out.append(x)\n    while out and not out[-1]:\n        out.pop()\n    out.reverse()\n    return out\n\n\nprint(retry_queue([]))\n'


def write(folder, name, dependency):
    base = folder / name
    (base / "src").mkdir(parents=True)
    (base / "requirements.txt").write_text(f"{dependency}\nredis\n")
    (base / "README.md").write_text("# T\n\nA tool.\n")
    (base / "src" / "app.py").write_text(CODE)


def test_chain(spark, tmp_path):
    now = F.lit(NOW).cast("timestamp")
    for name, dependency in (("one", "fastapi"), ("two", "pandas"), ("three", "fastapi")):
        write(tmp_path / "code", name, dependency)
    store = handlers.Store(spark, f"file://{tmp_path}/store")
    runner = jobs.Runner(spark, f"file://{tmp_path}/log", handlers.handlers(store, now, [f" file://{tmp_path}/code ", f"file://{tmp_path}/missing"]))
    ran = runner.run("scan", {"chain": True})
    states = {r.type: (r.status, r.error) for r in jobs.fold(runner.events()).collect()}
    assert {k: v[0] for k, v in states.items()} == {"scan": "completed", "index": "completed", "insight": "completed"}, states
    assert len(ran) == 3
    projects = {r.name: r for r in store.read("projects").collect()}
    assert set(projects) == {"one", "two", "three"} and all(p.language == "Python" and p.has_readme and p.loc > 5 for p in projects.values())
    assets = store.read("assets").collect()
    assert {a.name for a in assets} == {"retry_queue"} and len(assets) == 3
    caps = {r.name: r.project_count for r in store.read("capabilities").where("layer = 'capability'").collect()}
    assert caps["Caching"] == 3 and caps["Web API"] == 2 and caps["Data Processing"] == 1
    kinds = {r.relation_type: r["count"] for r in store.read("relations").groupBy("relation_type").count().collect()}
    assert kinds["similar_to"] == 3 and kinds["implements"] >= 6 and kinds["contains"] >= 3
    found = {r.id: r for r in store.read("insights").collect()}
    assert "ins_dup_cap_caching" in found and found["ins_dup_cap_caching"].confidence >= 0.55

    # A user's mark survives the next run; a second runner goes on in the log.
    marked = store.read("insights").withColumn("user_feedback", F.when(F.col("id") == "ins_dup_cap_caching", "useful"))
    store.replace("insights", marked)
    again = jobs.Runner(spark, f"file://{tmp_path}/log", handlers.handlers(store, now))
    (job,) = again.run("insight")
    assert job not in ran
    assert {r.id: r.user_feedback for r in store.read("insights").collect()}["ins_dup_cap_caching"] == "useful"
    errors = handlers.scan(store, [f"file://{tmp_path}/missing", f"file://{tmp_path}/code"], now).collect()
    assert [e.root for e in errors] == [f"file://{tmp_path}/missing"] and store.read("projects").count() == 3
    with pytest.raises(ValueError):
        handlers.scan(store, [f"file://{tmp_path}/missing"], now)
    with pytest.raises(ValueError):
        handlers.targets([" "], [])


def test_deep_and_looped_subtrees(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(11)] + [("a", "b"), ("b", "a")]
    rows = spark.createDataFrame(chain, "id string, parent_id string")
    assert {r.id for r in relational.subtree(rows, "n0").collect()} == {f"n{i}" for i in range(11)}
    assert {r.id for r in relational.subtree(rows, "a").collect()} == {"a", "b"}
    assert relational.subtree(rows, "nothing").count() == 0
