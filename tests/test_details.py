"""Details, mutations, errors and texts on small literal tables."""

import pytest
from pyspark.sql import functions as F

from forgelens.operators import relational
from forgelens.plans import details, errors, handlers, jobs, mutations, schema
from forgelens.sources import tables as versions


@pytest.fixture(scope="module")
def tables(spark):
    asset = f"id string, project_id string, type string, name string, description string, tags array<string>, source_path string, reuse_score double, confidence double, generality double, created_at string, evidence {schema.EVIDENCE}"
    return {
        "projects": spark.createDataFrame([("p", "P", "", "Rust", "active", True, "2024-05-01", None, 1500, '{"summary": "s", "trust": 0.5}'), ("q", "Q", "old", None, "paused", False, None, None, 0, "broken")], "id string, name string, description string, language string, status string, sensitive boolean, last_commit_at string, updated_at string, loc long, ai_profile string"),
        "assets": spark.createDataFrame([("a", "p", "code", "rag_queue", "", ["x"], "a.py", 0.9, 0.8, 0.9, "1", (["f.py"], ["c1"], None)), ("b", "gone", "code", "rag_queue", "", [], "b.py", 0.6, 0.8, 0.5, "1", ([], [], [])), ("c", "p", "code", "other", "", [], "c.py", 0.7, 0.8, 0.7, "2", None)], asset),
        "capabilities": spark.createDataFrame([("d", "AI", "domain", None, 1.0), ("c1", "Queue Work", "capability", "d", 0.9), ("c2", "Search", "capability", "d", 0.8)], "id string, name string, layer string, parent_id string, confidence double"),
        "relations": spark.createDataFrame([("1", "p", "implements", "c1", 0.8, []), ("2", "p", "implements", "c2", 0.3, []), ("3", "q", "similar_to", "p", 0.2, [])], "id string, source_id string, relation_type string, target_id string, confidence double, evidence array<string>"),
        "insights": spark.createDataFrame([("i", "tech_direction", "T", 0.9, None, ["p", "lost"], ["c", "a"]), ("j", "forgotten_asset", "U", 0.6, "useful", ["p"], []), ("k", "forgotten_asset", "V", 0.6, None, ["q"], [])], "id string, type string, title string, confidence double, user_feedback string, project_ids array<string>, asset_ids array<string>"),
        "opportunities": spark.createDataFrame([("o", "new", 4, 0.5, ["p", "q"], ["a", "c"], ["Queue Work", "Search"], ["Cache"], '{"mvp": "m", "scaffold": ["x"]}'), ("r", "new", 2, 0.5, ["p"], [], ["Search"], [], "  ")], "id string, status string, rating int, coverage double, source_project_ids array<string>, source_asset_ids array<string>, required_capabilities array<string>, missing_capabilities array<string>, analysis_json string"),
    }


def test_details(tables):
    found = details.asset_detail(tables, "a")
    row = found["asset"].first()
    assert (row.project_name, row.tier, row.percent) == ("P", "high", 80) and details.asset_detail(tables, "b")["asset"].first().project_name == details.GONE
    assert [(r.kind, r.label) for r in found["evidence"].collect()] == [("file", "f.py"), ("commit", "c1")] and details.asset_detail(tables, "c")["evidence"].count() == 0
    assert [r.id for r in found["duplicates"].collect()] == ["b"] and [r.capability for r in found["capabilities"].collect()] == ["Queue Work"]
    found = details.insight_detail(tables, "i")
    assert [r.id for r in found["projects"].collect()] == ["p"] and [r.id for r in found["assets"].collect()] == ["c", "a"] and [r.id for r in found["related"].collect()] == ["j"]
    assert found["insight"].first().state == "pending"
    found = details.opportunity_detail(tables, "o")
    assert found["analysis"].first().analysis.mvp == "m" and found["opportunity"].first().stars == "★★★★☆" and [r.id for r in found["projects"].collect()] == ["p", "q"]
    assert details.opportunity_detail(tables, "r")["analysis"].count() == 0
    assert details.project_detail(tables, "p")["profile"].first().trust == 0.5 and details.project_detail(tables, "q")["profile"].where("summary IS NOT NULL").count() == 0


def test_a_corrupt_analysis_is_an_error(spark, tables):
    for text in ("[1]", "{broken", "text"):
        bad = tables["opportunities"].withColumn("analysis_json", F.lit(text))
        with pytest.raises(Exception, match="corrupt analysis of"):
            details.stored_analysis(bad).collect()


def test_deep_analysis(tables):
    rows = {r.id: r for r in details.deep_analysis(tables["opportunities"], tables["assets"]).collect()}
    assert [(p.name, p.note) for p in rows["o"].parts] == [("rag_queue", "use as it is"), ("other", "adapt its interface")]
    assert rows["o"].scaffold == ["README.md", "src/queue_work/", "src/search/", "tests/"] and rows["o"].mvp == "A first version joins Queue Work, Search of 2 projects. To be added: Cache."
    assert rows["r"].parts == [] and rows["r"].mvp.endswith("Nothing is missing.")


def test_graph_helpers(spark, tables):
    assert {r.node: r.weight for r in details.capability_weights(tables["capabilities"], tables["relations"]).collect()} == {"d": 0, "c1": 1, "c2": 1}
    stats = spark.createDataFrame([(5, 7, 2, 0, 1)], "nodes int, edges int, omitted int, dangling int, isolated int")
    assert details.graph_summary(stats).first().summary == "5 nodes, 7 edges, 2 not shown, 1 alone"
    row = spark.range(1).select(details.project_subtitle(F.lit("Rust"), F.lit(0), F.lit(1500)).alias("s"), details.page_link(F.lit("project"), F.lit("p")).alias("l"), details.page_link(F.lit("idea"), F.lit("p")).alias("n")).first()
    assert tuple(row) == ("Rust · 1.5k lines", "/projects/p", None)


def test_texts(spark, tables):
    now = F.lit("2024-06-01").cast("timestamp")
    known = spark.createDataFrame([("p", "Search", 0.5), ("p", "Queue Work", 0.9)], "project_id string, name string, confidence double")
    prompts = {r.id: r.prompt for r in details.profile_prompt(tables["projects"], tables["assets"], known, 1).collect()}
    assert "Capabilities:\n- Queue Work\n\nAssets:\n- rag_queue [a]" in prompts["p"] and "Language: Rust" in prompts["p"] and "Assets:" not in prompts["q"] and "Language" not in prompts["q"]
    plain = {r.id: (r.summary, r.narrative) for r in details.plain_profile(tables["projects"], tables["assets"], now).collect()}
    assert plain["p"] == ("P: Rust with 1.5k lines.", "It is being worked on. 2 of its 2 assets can be used elsewhere.") and plain["q"][1] == "Nothing is known of its last change. Nothing of it stands out for reuse."
    hits = spark.createDataFrame([("asset", "a", "Queue", 0.9), ("asset", "b", "Other", 0.8), ("project", "p", "P", 0.5), ("odd", "x", "X", 1.0)], "kind string, id string, title string, score double")
    assert [r.question for r in details.follow_ups(hits).collect()] == ["Where else is Queue used?", "What can be reused from P?"]
    view = details.search_view(hits, hits.agg(F.count("*").alias("total")), "queue", language=" ", status="active", types=[])
    assert view["applied"] == {"status": "active"} and view["hint"] is None and view["items"].first().percent == 90
    none = hits.limit(0)
    assert details.search_view(none, none.agg(F.count("*").alias("total")), "zzz", unfiltered=3)["hint"] != details.search_view(none, none.agg(F.count("*").alias("total")), "")["hint"]


def test_folders(spark, tmp_path):
    for name in ("b", "A", ".hidden", "c"):
        (tmp_path / name).mkdir()
    (tmp_path / "file").write_text("x")
    found, more = details.folders(spark, str(tmp_path))
    assert [r.name for r in found.collect()] == ["A", "b", "c"] and not more
    found, more = details.folders(spark, str(tmp_path), hidden=True, most=2)
    assert [r.name for r in found.collect()] == [".hidden", "A"] and more
    with pytest.raises(FileNotFoundError):
        details.folders(spark, str(tmp_path / "file"))


def test_mutations_on_a_store(spark, tmp_path, tables):
    store = handlers.Store(spark, f"file://{tmp_path}/store")
    audit = spark.createDataFrame([(7, "cloud:x", "p", "s", None, True)], "seq long, model string, project_id string, summary string, created_at timestamp, ok boolean")
    activities = spark.createDataFrame([(1, "x", None)], "seq long, text string, created_at timestamp")
    store.commit({**tables, "audit_log": audit, "activities": activities})
    change, now = mutations.Projects(store), F.lit("2024-06-01").cast("timestamp")
    change.set_sensitive("p", False, now)
    change.set_sensitive("q", True, now)
    assert {r.id: r.sensitive for r in store.read("projects").collect()} == {"p": False, "q": True}
    assert [(r.seq, r.model, r.project_id, r.ok) for r in store.read("audit_log").orderBy("seq").collect()] == [(7, "cloud:x", "p", True), (8, "-", "p", None)]
    change.set_description("q", "  " + "é" * 600)
    change.set_description("p", "   ")
    assert {r.id: r.description for r in store.read("projects").collect()} == {"p": None, "q": "é" * 500}
    change.set_feedback("insights", "i", "useful")
    change.set_feedback("insights", "j", None)
    assert {r.id: r.user_feedback for r in store.read("insights").collect()} == {"i": "useful", "j": None, "k": None}
    for call, kind in ((lambda: change.set_description("zz", "x"), errors.NotFound), (lambda: change.set_feedback("insights", "i", "odd"), errors.Invalid), (lambda: change.set_feedback("insights", "zz", None), errors.NotFound)):
        before = store.version()
        with pytest.raises(kind):
            call()
        assert store.version() == before
    assert {r.table: r.n for r in change.clear_derived().collect()} == {"assets": 3, "capabilities": 3, "relations": 3, "insights": 3, "opportunities": 2, "activities": 1}
    assert store.read("assets").count() == 0 and store.read("audit_log").count() == 2 and {r.id: (r.sensitive, r.ai_profile) for r in store.read("projects").collect()}["q"] == (True, None)
    change.remove("q")
    assert [r.id for r in store.read("projects").collect()] == ["p"]


def test_pure_mutations(spark, tables):
    counts = {r.id: (r.symbol_count, r.module_count) for r in mutations.set_symbol_counts(tables["projects"], spark.createDataFrame([("p", "f", "a.py"), ("p", "g", "a.py")], "project_id string, name string, file_path string")).collect()}
    assert counts == {"p": (2, 1), "q": (0, 0)}
    edges = tables["relations"]
    assert {r.id for r in mutations.prune_relations(edges, 0.5).collect()} == {"1"} and {r.id for r in mutations.prune_relations(edges, 0.5, ["implements"]).collect()} == {"1", "3"}
    assert {r.id for r in mutations.delete_types(tables["insights"], ["forgotten_asset"]).collect()} == {"i"} and mutations.delete_types(tables["insights"], []).count() == 3
    wanted = spark.createDataFrame([("p", "new"), ("zz", "x")], "id string, value string")
    assert {r.id: r.ai_profile for r in mutations.set_profile(tables["projects"].drop("ai_profile"), wanted).collect()} == {"p": "new", "q": None}


def test_errors():
    cases = [(errors.NotFound("project", "p"), 404, "not_found"), (jobs.Busy("scan"), 409, "busy"), (versions.Conflict("x"), 409, "conflict"), (errors.Corrupt("x"), 500, "corrupt"), (errors.Invalid("x"), 400, "invalid"), (FileNotFoundError("x"), 404, "no_folder"), (PermissionError("x"), 403, "forbidden")]
    for error, status, code in cases:
        out = errors.described(error)
        assert (out["status"], out["code"]) == (status, code) and out["hint"]
    with pytest.raises(ValueError) as caught:
        relational.checked_score(2)
    assert errors.described(caught.value)["status"] == 400
    assert errors.described(RuntimeError("secret path"))["message"] == "internal error"


def test_append_in_ranges(spark):
    log = spark.createDataFrame([(5, "z", None)], "seq long, text string, created_at timestamp")
    rows = spark.range(5000).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text")).unionByName(spark.createDataFrame([(None,), ("r00000",)], "text string"))
    out = relational.append(log, rows.repartition(7), F.lit("2024-01-01").cast("timestamp")).where("seq > 5").orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(6, 5008)) and [r.text for r in out][:4] == [None, "r00000", "r00000", "r00001"] and [r.text for r in out][1:] == sorted(r.text for r in out[1:])
