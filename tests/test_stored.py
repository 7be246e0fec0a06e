"""Exported tables become typed rows by the cell, and go back."""

import json

import pytest
from pyspark.sql import functions as F

from forgelens.functions import enums
from forgelens.plans import details, views
from forgelens.sources import stored

PROFILE = {"summary": "s", "purpose": None, "highlights": [{"title": "t", "desc": "d", "evidence_files": ["a.py"]}], "archaeology": {"sessions": 1, "commits": 2, "completeness": 0.5, "salvage": [], "narrative": "n"}, "generated_by": "m", "generated_at": "2024"}


def one(spark, raw, shape):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    return [x.asDict(True)["v"] for x in rows.select("i", stored.parsed(F.col("r"), shape).alias("v")).orderBy("i").collect()]


def test_lists_hold_one_type_and_nothing_behind(spark):
    raw = ['["a","b"]', "[]", ' [ "ü\\n" ] ', '["a",1]', '["a",null]', "[null]", '["a"] x', '"a"],["b"', '"a"', "{}", "null", "", " ", None, '["a"', "garbage", '["a"],"w":["b"]', '[["a"]]']
    assert one(spark, raw, stored.many(stored.TEXT)) == [["a", "b"], [], ["ü\n"], *[None] * 15]


def test_numbers_keep_their_bounds(spark):
    raw = ["0", "255", "256", "-1", "1.5", "1.0", '"1"', "true", "null"]
    assert one(spark, raw, stored.BYTE) == [0, 255, *[None] * 7]
    assert one(spark, ["1", "-2.5", "1e3", '"1"', "true"], stored.REAL) == [1.0, -2.5, 1000.0, None, None]


def test_records_need_their_fields(spark):
    share = {"name": "Rust", "pct": 40, "loc": 7}
    raw = [json.dumps(x) for x in (share, share | {"more": 1}, {"name": "Rust", "pct": 40}, share | {"pct": 300}, share | {"name": None}, [], "x")]
    assert one(spark, raw, stored.SHARE) == [share, share, None, None, None, None, None]
    items = [[{"kind": "file", "label": "a"}], [{"kind": "file", "label": "a", "target": None}], [{"kind": "file", "label": "a", "target": "t"}], [{"kind": "file", "label": "a", "target": 1}], [{"kind": "page", "label": "a"}], [{"kind": "file", "label": "a"}, {}]]
    got = one(spark, [json.dumps(x) for x in items], stored.many(stored.ITEM))
    none, full = {"kind": "file", "label": "a", "target": None}, {"kind": "file", "label": "a", "target": "t"}
    assert got == [[none], [none], [full], None, None, None]


def test_nested_records(spark):
    deep, plain = PROFILE, PROFILE | {"archaeology": None}
    broken = PROFILE | {"archaeology": {"sessions": -1}}
    got = one(spark, [json.dumps(x) for x in (deep, plain, broken, PROFILE | {"highlights": [{"title": "t"}]})], stored.PROFILE)
    past = PROFILE["archaeology"] | {"phase": None}
    assert got == [deep | {"phase": None, "archaeology": past}, plain | {"phase": None}, None, None]


def test_cells_become_defaults_and_rows_stay(spark):
    rows = spark.createDataFrame(
        [("p1", "active", 900, -3, 1, "true", '[{"name":"Go","pct":9,"loc":1}]', "[", None, json.dumps(PROFILE), 1), ("p2", "no such", None, 5, 0, None, None, '["x"]', 2**40, "null", 2)],
        "id string, status string, health_score long, loc long, has_git int, sensitive string, languages_json string, tags_json string, git_commits long, ai_profile_json string, tags int",
    )
    got = {r["id"]: r.asDict(True) for r in stored.typed(rows, "projects").collect()}
    a, b = got["p1"], got["p2"]
    assert (a["status"], a["health_score"], a["loc"], a["has_git"], a["sensitive"], a["languages"], a["tags"], a["git_commits"]) == ("active", 255, 0, True, True, [{"name": "Go", "pct": 9, "loc": 1}], [], 0)
    assert (b["status"], b["health_score"], b["loc"], b["has_git"], b["sensitive"], b["languages"], b["tags"], b["git_commits"], b["ai_profile"]) == ("unknown", 0, 5, False, False, [], ["x"], 2**32 - 1, None)
    assert a["ai_profile"]["archaeology"]["commits"] == 2 and a["framework"] == "-" and a["scanned_at"] is None and a["description"] == ""
    assert [tuple(r) for r in stored.unreadable(rows, "projects").collect()] == [("p1", "tags_json", "[")]


def test_insights_without_readable_evidence_say_so(spark):
    rows = spark.createDataFrame([("i1", "forgotten_asset", "[]", "useful"), ("i2", "x", "{", "x"), ("i3", "x", '[{"kind":"commit","label":"c"}]', None)], "id string, type string, evidence_json string, user_feedback string")
    got = {r["id"]: r for r in stored.typed(rows, "insights").collect()}
    assert [got[i]["evidence"][0]["label"] for i in ("i1", "i2", "i3")] == [stored.UNREADABLE_EVIDENCE] * 2 + ["c"]
    assert [got[i]["type"] for i in ("i1", "i2")] == ["forgotten_asset", "reusable_component"] and [got[i]["user_feedback"] for i in ("i1", "i2", "i3")] == ["useful", None, None]
    assert [tuple(r) for r in stored.unreadable(rows, "insights").collect()] == [("i2", "evidence_json", "{")]


def test_unknown_ends_of_relations_differ_by_side(spark):
    rows = spark.createDataFrame([("r", "?", "?", "?")], "id string, source_type string, relation_type string, target_type string")
    r = stored.typed(rows, "relations").first()
    assert (r["source_type"], r["relation_type"], r["target_type"], r["confidence"], r["evidence"]) == ("project", "related_to", "capability", 0.0, [])


def test_job_numbers_and_payloads(spark):
    texts = spark.createDataFrame([("j", "many", "-2", "0.5x")], "id string, processed string, total string, progress string")
    assert tuple(stored.typed(texts, "jobs").select("processed", "total", "progress").first()) == (None, 0, 0.0)
    rows = spark.createDataFrame([("j1", -5, None, "{bad"), ("j2", 3, 9, '{"mode": "full"}')], "id string, processed long, total long, payload_json string")
    got = [tuple(r) for r in stored.typed(rows, "jobs").orderBy("id").select("type", "status", "processed", "total", "payload").collect()]
    assert got == [("INDEX_CODE", "queued", 0, None, None), ("INDEX_CODE", "queued", 3, 9, '{"mode": "full"}')]


@pytest.mark.parametrize("table", stored.TABLES)
def test_typed_rows_go_back(spark, table):
    raw = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit('["a"]').alias("tags_json"), F.lit('{"files":["f"],"commits":[],"used_by":["p"],"reasoning":[]}').alias("evidence_json"), F.lit("x").alias("key"))
    first = stored.typed(raw, table)
    again = stored.typed(stored.stored(first, table), table)
    assert again.schema.simpleString() == first.schema.simpleString()
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))


def test_empty_tables_and_unknown_names(spark):
    none = spark.createDataFrame([], "id string")
    for table in stored.TABLES:
        assert stored.typed(none if table != "settings" else none.toDF("key"), table).count() == 0
    assert stored.unreadable(none, "capabilities").count() == 0
    with pytest.raises(ValueError):
        stored.read(spark, "/nowhere", "pages")
    assert set(stored._cells()) == set(stored.TABLES) and enums.UNKNOWN["activity_icon"] == "check"


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_an_export_feeds_the_views(spark, tmp_path, form):
    project = spark.createDataFrame([("p1", "alpha", "active", 80, 10, '["Go"]', "Go"), ("p2", "beta, \"b\"", "??", 300, 20, "no", "Rust")], "id string, name string, status string, health_score int, loc int, tags_json string, language string")
    asset = spark.createDataFrame([("a1", "p1", "component", "Button", 0.9, '["ui"]')], "id string, project_id string, type string, name string, reuse_score double, tags_json string")
    made = {"projects": project, "assets": asset}
    for table in stored.TABLES:
        rows = stored.typed(made.get(table, spark.createDataFrame([], "id string")), table) if table in made else stored.typed(spark.createDataFrame([], "id string"), table)
        full = stored.stored(rows, table)
        writer = full.coalesce(1).write.format(form)
        (writer.option("header", "true").option("escape", '"') if form == "csv" else writer).save(str(tmp_path / table))
    tables = stored.read_all(spark, str(tmp_path), form)
    now = F.lit("2024-01-01").cast("timestamp")
    listed = views.project_list(tables, now)
    assert [(r["name"], r["status"], r["health_score"], r["tags"]) for r in listed["items"].orderBy("id").collect()] == [("alpha", "active", 80, ["Go"]), ('beta, "b"', "unknown", 255, [])]
    found = details.asset_detail(tables, "a1")
    assert [(r["project_name"], r["tier"]) for r in found["asset"].collect()] == [("alpha", "high")] and found["evidence"].count() == 0
