"""The first page, breakdowns, and the tree as rows."""

import pytest
from pyspark.sql import functions as F

from forgelens.operators import relational
from forgelens.plans import overview
from forgelens.sources import stored

NOW = "2024-06-01 12:00:00"


def typed(spark, table, schema, *rows):
    return stored.typed(spark.createDataFrame(list(rows), schema), table)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "projects": typed(spark, "projects", "id string, scanned_at string", ("p", "2024"), ("q", " "), ("r", None)),
        "assets": typed(spark, "assets", "id string, reuse_score double, type string", ("a", 0.7, "api"), ("b", 0.69, "idea"), ("c", 0.1, "no such")),
        "capabilities": typed(spark, "capabilities", "id string, name string, layer string, parent_id string, project_count long", ("d", "AI", "domain", None, 3), ("c", "RAG", "capability", "d", 2), ("e", "Agents", "capability", "d", 2), ("i", "faiss", "implementation", "c", 1)),
        "relations": typed(spark, "relations", "id string", ("1",), ("2",)),
        "insights": typed(spark, "insights", "id string, confidence double, user_feedback string", ("i", 0.9, None), ("j", 0.7, "useful"), ("k", 0.2, "useless"), ("l", 0.8, "ignored"), ("m", 0.8, None)),
        "opportunities": typed(spark, "opportunities", "id string, rating long, status string, source_asset_ids_json string, missing_capabilities_json string", ("o", 5, "new", '["a","b"]', '["x"]'), ("d", 5, "dismissed", None, None), ("n", 4, "explored", None, "["), ("u", 3, "no such", None, None), ("v", 2, "new", None, None)),
        "activities": typed(spark, "activities", "id string, title string, created_at string", *[(str(i), f"t{i}", f"2024-06-01 11:0{i}:00") for i in range(8)]),
        "jobs": typed(spark, "jobs", "id string, status string, progress double, created_at string, updated_at string, processed long, total long", ("1", "running", 0.254, "1", "9", 3, 9), ("2", "running", 0.5, "2", "3", None, None), ("3", "completed", 1.0, "5", "99", None, None)),
    }


def test_the_page(spark, tables):
    page = overview.overview(tables, F.lit(NOW).cast("timestamp"), directories=1)
    assert [tuple(r) for r in page["cards"].collect()] == [
        ("projects", 3, "1 scanned", "projects", False), ("assets", 3, "1 highly reusable", "assets", False), ("capabilities", 2, None, "graph", False), ("insights", 5, "2 to be read", "insights", True),
    ]
    assert [tuple(r) for r in page["capabilities"].collect()] == [("Agents", 2), ("RAG", 2)] and tuple(page["graph"].first()) == (4, 2)
    assert [(r["id"], r["badge"]) for r in page["insights"].collect()] == [("i", "high"), ("l", "potent"), ("m", "potent"), ("j", "potent")]
    assert [(r["id"], r["reusable"], r["missing"]) for r in page["opportunities"].collect()] == [("o", 2, 1), ("n", 0, 0), ("u", 0, 0)]
    assert [(r["id"], r["when"]) for r in page["activities"].collect()] == [(str(i), f"{60 - i} min ago" if i else "1 h ago") for i in range(7, 1, -1)]
    job = page["job"].first()
    assert (job["id"], job["percent"], job["counter"], job["cancellable"]) == ("1", 25, "3/9", True)
    assert page["headline"] is None and [r["done"] for r in page["steps"].collect()] == [True, True, True, False]


def test_a_new_store(spark, tables):
    none = {t: df.limit(0) for t, df in tables.items() if t in ("projects", "assets", "capabilities", "insights")}
    page = overview.overview(none, F.lit(NOW).cast("timestamp"))
    assert [(r["value"], r["detail"]) for r in page["cards"].collect()] == [(0, None)] * 4 and "job" not in page
    assert page["headline"] == "Begin with a directory." and [r["action"] for r in page["steps"].collect()] == ["add a directory", "add a directory", "index", None]
    assert overview.steps(spark, 2, 0, True, 1, False)[0].startswith("The projects are scanned") and overview.steps(spark, 0, 0, False, 1, True)[0].startswith("The directory is there")


def test_without_a_running_job_the_newest_is_shown(tables):
    ended = tables["jobs"].withColumn("status", F.when(F.col("id") == "1", "cancelled").otherwise("failed"))
    assert overview.job_brief(ended).first()["id"] == "3" and overview.job_brief(ended.limit(0)).count() == 0


def test_breakdowns(spark, tables):
    raw = spark.createDataFrame([("api",), ("api",), ("no such",), (None,)], "type string")
    got = {r["value"]: (r["n"], r["share"]) for r in overview.breakdown(raw, "type", "asset_type").collect()}
    assert len(got) == 10 and got["api"] == (2, 0.5) and got["code"] == (2, 0.5) and got["idea"] == (0, 0.0)
    assert [r["value"] for r in overview.breakdown(raw, "type", "asset_type", zeros=False).collect()] == ["code", "api"]
    assert {r["share"] for r in overview.breakdown(raw.limit(0), "type", "asset_type").collect()} == {0.0}
    marks = spark.createDataFrame([("useful",), (None,), ("x",)], "f string")
    assert [(r["value"], r["n"], r["share"]) for r in overview.breakdown(marks, "f", "user_feedback", zeros=False).collect()] == [("useful", 1, 1.0)]
    assert tuple(overview.summary(tables["insights"], tables["opportunities"]).first()) == (5, 2, 5, 4, 0.5)
    assert tuple(overview.summary(tables["insights"].limit(0), tables["opportunities"].limit(0)).first()) == (0, 0, 0, 0, None)


def test_tree_rows_and_orphans(spark):
    rows = [
        ("d1", "Web", "domain", None, 1), ("d2", "AI", "domain", None, 5), ("d3", "Data", "domain", None, 5), ("c1", "RAG", "capability", "d2", 1), ("c2", "Agents", "capability", "d2", 4), ("c3", "Chat", "capability", "d2", 4),
        ("i1", "b", "implementation", "c1", 0), ("i2", "a", "implementation", "c1", 9), ("x1", "lost", "capability", "gone", 1), ("x2", "none", "implementation", None, 1), ("x3", "under lost", "implementation", "x1", 1), ("x4", "skips", "implementation", "d1", 1),
    ]
    caps = spark.createDataFrame(rows, "id string, name string, layer string, parent_id string, project_count long").withColumn("confidence", F.lit(1.0)).repartition(4)
    tree = relational.tree_rows(caps)
    assert [r["id"] for r in tree.collect()] == ["d2", "c2", "c3", "c1", "i2", "i1", "d3", "d1"]
    assert {(r["domain_id"], r["capability_id"]) for r in tree.where("id = 'i1'").collect()} == {("d2", "c1")}
    assert sorted(r["id"] for r in relational.tree_orphans(caps).collect()) == ["x1", "x2"]
    assert relational.tree_rows(caps.limit(0)).count() == 0 and relational.tree_orphans(caps.limit(0)).count() == 0
