"""Pages, details and answers on small literal tables."""

import pytest
from pyspark.sql import functions as F

from forgelens.plans import analyst, views

NOW = "2024-06-01 12:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    asset = "id string, project_id string, type string, name string, description string, tags array<string>, source_path string, reuse_score double, confidence double, created_at string, evidence struct<files: array<string>, commits: array<string>>"
    return {
        "projects": spark.createDataFrame([("p", "P", "", ["x"], "Rust", "active", False, "2024-05-01", "2024-05-02", 90, 1500, True, 12), ("q", "Q", "", [], None, "paused", True, None, None, 20, 10, False, 0)], "id string, name string, description string, tags array<string>, language string, status string, sensitive boolean, last_commit_at string, updated_at string, health_score int, loc long, has_git boolean, git_commits int"),
        "assets": spark.createDataFrame([("a", "p", "code", "Queue", "", [], "a.py", 0.9, 0.8, "1", (["f"], [])), ("b", "gone", "code", "Queue", "", [], "b.py", 0.6, 0.8, "1", (["f"], []))], asset),
        "capabilities": spark.createDataFrame([("d", "AI", "domain", None, 0), ("c", "RAG", "capability", "d", 1)], "id string, name string, layer string, parent_id string, project_count int"),
        "relations": spark.createDataFrame([("1", "p", "implements", "c", 0.8, []), ("2", "q", "similar_to", "p", 0.7, []), ("3", "p", "similar_to", "lost", 0.9, [])], "id string, source_id string, relation_type string, target_id string, confidence double, evidence array<string>"),
        "insights": spark.createDataFrame([("i", "tech_direction", "T", 0.9, "1", None, ["p"]), ("j", "forgotten_asset", "U", 0.6, "1", "useful", ["q"])], "id string, type string, title string, confidence double, created_at string, user_feedback string, project_ids array<string>"),
        "opportunities": spark.createDataFrame([("o", "new", 4, 0.5, "1")], "id string, status string, rating int, coverage double, created_at string"),
    }


def test_pages(spark, tables):
    now = F.lit(NOW).cast("timestamp")
    page = views.project_list(tables, now, "health", status="active")
    row = page["items"].first()
    assert (row.id, row.idle, row.size_text, row.age) == ("p", 30, "1.5k", "1 mo ago") and page["total"].first().total == 1 and [r.n for r in page["statuses"].collect()] == [1, 1, 0, 0]
    detail = views.project_detail(tables, "p")
    assert [r.domain for r in detail["capabilities"].collect()] == ["AI"] and [r.id for r in detail["similar"].collect()] == ["q"] and [r.id for r in detail["insights"].collect()] == ["i"] and detail["assets"].count() == 1
    assert views.archaeology(tables["projects"], tables["assets"], now).first().narrative == "P has 12 commits. Worth saving: Queue."
    found = views.asset_list(tables, types=["api"])
    assert found["items"].count() == 0 and found["types"].first().n == 2
    assert {r.id: r.project_name for r in views.asset_list(tables)["items"].collect()} == {"a": "P", "b": "(removed project)"}
    assert [r.id for r in views.duplicates_of(tables["assets"], tables["projects"], "a").collect()] == ["b"]
    assert [(r.id, r.badge, r.state) for r in views.insight_list(tables)["items"].collect()] == [("i", "high", "pending"), ("j", "info", "useful")]
    assert [r.id for r in views.related(spark.createDataFrame([(["b", "zz", "a"],)], "ids array<string>"), tables["assets"]).collect()] == ["b", "a"]
    assert views.dashboard(tables, now)["reusable"].first().reusable == 1 and views.opportunity_list(tables)["items"].first().stars == "★★★★☆"
    assert views.empty_hint(0, 3) != views.empty_hint(0, 0) and views.empty_hint(1, 1) is None
    assert views.onboarding(1, 1, 1, 0) == {"directory": True, "scan": True, "index": True, "model": False, "hidden": True}
    assert views.add_directory(["/a/"], "/a") == ["/a"]


def test_settings(spark):
    s = views.Settings.empty(spark).save({"model": "x", "key": "sk-123456789"}, ["key"]).save({"model": "y"})
    assert {r.key: r.value for r in s.shown().collect()} == {"model": "y", "key": "sk-1****6789"} and [r.key for r in s.export().collect()] == ["model"]


def test_answers(spark):
    hits = spark.createDataFrame([("asset", f"a{i}", f"T{i}", i / 20) for i in range(15)] + [("project", "p1", "P", 0.99)], "kind string, id string, title string, score double")
    top = analyst.context(hits)
    assert [r.id for r in top.orderBy("place").collect()][:2] == ["p1", "a14"] and top.count() == 12
    row = analyst.verify(spark.createDataFrame([(1, "as [p1] and [a14], [p1], not [zz]"), (2, "nothing")], "answer_id int, text string"), top).orderBy("answer_id").collect()
    assert (row[0].citations, row[0].rejected, row[1].citations, row[1].rejected) == (["p1", "a14"], 1, [], 0)
    assert analyst.plain_answer(top).first().answer == "Found: 11 asset, 1 project." and analyst.plain_answer(top.limit(0)).first().answer.startswith("There is no")
    assert analyst.prompt(" why? ", top).first().prompt.endswith("Question: why?")
    yes, no = F.lit(True), F.lit(False)
    assert spark.range(1).select(analyst.route(yes, yes, yes), analyst.route(no, yes, yes), analyst.route(no, no, yes), analyst.route(no, yes, no)).first()[:] == ("local", "deep", "fast", "local")
    trust = analyst.trust(spark.createDataFrame([("p", ["a.py", "no.py"], ["x"]), ("q", None, [])], "project_id string, files array<string>, assets array<string>"), spark.createDataFrame([("p", "a.py")], "project_id string, rel_path string"), spark.createDataFrame([("p", "x")], "project_id string, id string"))
    assert {r.project_id: round(r.trust, 3) for r in trust.collect()} == {"p": 0.667, "q": 0.0}
