"""Operators on small literal tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from forgelens.functions import enums, rules
from forgelens.functions import scalars as S
from forgelens.operators import capabilities, graph, insights, ranking, relational, retrieval, scoring
from forgelens.plans import handlers, jobs, merge
from forgelens.sources import manifests, projects, symbols
from forgelens.streaming import progress

NOW = "2024-06-01 12:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.non_empty(lit("  "))) is None
    assert one(spark, S.contains_text(lit("50% off"), "0%")) and not one(spark, S.contains_text(lit("500 off"), "0%"))
    assert str(one(spark, S.parse_time(lit("2024-01-02")))) == "2024-01-02 00:00:00" and one(spark, S.parse_time(lit("soon"))) is None
    now = lit(NOW).cast("timestamp")
    assert one(spark, S.whole_days(lit("2024-05-31 13:00:00").cast("timestamp"), now)) == 0
    assert one(spark, S.idle_days(lit(None).cast("timestamp"), lit("2024-05-01").cast("timestamp"), now)) == 31
    assert one(spark, S.relative_time(F.lit(None).cast("timestamp"), now)) == ""
    assert [one(spark, S.relative_time(lit(t).cast("timestamp"), now)) for t in ("2024-06-01 11:59:30", "2024-06-01 11:00:00", "2024-05-30 12:00:00", "2022-01-01")] == ["just now", "1 h ago", "2 d ago", "2 y ago"]
    assert [one(spark, S.format_bytes(lit(n))) for n in (512, 1536, 3 * 1024**3)] == ["512 B", "1.5 KB", "3.0 GB"]
    assert [one(spark, S.format_count(lit(n))) for n in (999, 1500, 2_000_000)] == ["999", "1.5k", "2.0M"]
    assert one(spark, S.stars(lit(3))) == "★★★☆☆" and one(spark, S.percent(lit(1.7))) == 100
    assert one(spark, S.mask_key(lit("sk-1234567890"))) == "sk-1****7890" and one(spark, S.mask_key(lit("short"))) == "****"
    assert one(spark, S.citation_ids(lit("see [a1] and [b_2], again [a1] not [x y]"))) == ["a1", "b_2"]
    assert one(spark, S.json_of_reply(lit('```json\n{"k": 3}\n```'), "k long"))["k"] == 3
    assert one(spark, S.split_identifier(lit("parseHTTPRequest_v2"))) == ["parse", "http", "request", "v2"]
    assert one(spark, S.normalize_path(lit("C:\\work\\a\\"))) == "C:/work/a"
    assert one(spark, S.slug(lit(" Web API!"))) == "web_api"
    assert one(spark, enums.read_as(lit("odd"), "asset_type")) == "code" and one(spark, enums.insight_badge(lit(0.7))) == "potent"


def test_filters(spark):
    df = spark.createDataFrame([("1", "p", "code", "Queue_1", "d", ["py"], "a.py", 0.9, (["f"], [])), ("2", "q", "api", "100%", None, [], "b.py", 0.5, ([], []))], "id string, project_id string, type string, name string, description string, tags array<string>, source_path string, reuse_score double, evidence struct<files: array<string>, commits: array<string>>")
    ids = lambda **k: [r.id for r in relational.filter_assets(df, **k).orderBy("id").collect()]
    assert ids() == ["1", "2"] and ids(text="  ") == ["1", "2"] and ids(text="queue_") == ["1"] and ids(text="0%") == ["2"] and ids(text="PY") == ["1", "2"]
    assert ids(tier="high") == ["1"] and ids(with_evidence=True) == ["1"] and ids(types=["api"]) == ["2"] and ids(project_id="q", min_score=0.4) == ["2"]
    with pytest.raises(ValueError):
        ids(min_score=1.5)
    opp = spark.createDataFrame([("a", "new", 5), ("b", "adopted", 2)], "id string, status string, rating int")
    assert relational.filter_opportunities(opp).count() == 1 and relational.filter_opportunities(opp, []).count() == 0 and relational.filter_opportunities(opp, None).count() == 2
    assert [r.n for r in relational.facet(opp, "status", enums.lookup(spark, "opportunity_status")).collect()] == [1, 0, 0, 1]
    assert relational.page(df, "asset", relational.order("asset.reuse"), 1, 1).first().id == "2"


def test_tree(spark):
    caps = spark.createDataFrame([("d", "AI", "domain", None, 1.0, 0), ("c1", "OCR", "capability", "d", 0.9, 2), ("c2", "RAG", "capability", "d", 0.8, 5), ("i", "X", "implementation", "c1", 0.7, 0), ("o", "Lost", "capability", "gone", 0.6, 0)], "id string, name string, layer string, parent_id string, confidence double, project_count long")
    rows = {r.domain: r for r in relational.tree(caps).collect()}
    assert [c.name for c in rows["AI"].capabilities] == ["RAG", "OCR"] and [c.name for c in rows[None].capabilities] == ["Lost"]
    assert sorted(r.id for r in relational.subtree(caps, "d").collect()) == ["c1", "c2", "d", "i"]
    assert [r.id for r in relational.orphans(caps).orderBy("id").collect()] == ["i", "o"]
    assert merge.gate(caps, merge.valid_capability())[1].first().accepted == 5


def test_retrieval(spark):
    assert retrieval.compile_query("ab task") is None and retrieval.needs_fallback("ab") and not retrieval.needs_fallback("  ")
    assert retrieval.compile_query("任务队列") == [["任务队列", "任务队", "务队列"]]
    df = spark.createDataFrame([("1", "task queue", "retry of tasks", "", "p/a"), ("2", "queue", "nothing", "", "p/b"), ("3", "other", "a task", "", "p/c")], "id string, name string, description string, tags string, source_path string").withColumn("reuse_score", F.lit(0.5))
    index = retrieval.postings(df, "asset", retrieval.INDEXED["asset"])
    for i in (None, index):
        found = retrieval.match(df, retrieval.INDEXED["asset"], "task queue", i, "asset").collect()
        assert [r.id for r in found] == ["1"] and 0 < found[0].relevance < 1
    assert [r.id for r in retrieval.recall(df, "asset", "qu").collect()] == ["1", "2"]
    assert retrieval.match(df, ["name"], "100% task").count() == 0


def test_snippet(spark):
    assert one(spark, ranking.snippet(F.lit("a <b> " + "x" * 20 + " Needle & rest of the text"), ["needle"])) == "…" + "x" * 11 + " <mark>Needle</mark> &amp; rest of t…"
    assert one(spark, ranking.snippet(F.lit("short & plain"), ["zzz"])) == "short &amp; plain"
    assert one(spark, ranking.strip_marks(F.lit("a <mark>b</mark>"))) == "a b"


def test_scoring(spark):
    rows = [("retry_queue", "function", "pub fn retry_queue(n: u32) -> bool", "Retries.", 20, None, True), ("tmp_x", "function", "fn tmp_x()", None, 50, None, True), ("invoice", "constant", "x", None, 9, None, False), ("tiny", "class", "class tiny", "doc", 2, None, True)]
    got = {r.name: r for r in scoring.score_symbols(spark.createDataFrame(rows, "name string, kind string, signature string, doc_comment string, body_lines int, parent string, referenced_locally boolean")).collect()}
    r = got["retry_queue"]
    assert (r.reuse_score, r.generality, r.stability, r.confidence, r.worth_tracking) == (0.96, 0.94, 0.95, 0.92, True)
    assert (got["tmp_x"].reuse_score, got["tmp_x"].confidence) == (0.0, 0.9) and not any(got[n].worth_tracking for n in ("tmp_x", "invoice", "tiny"))
    health = lambda *a: one(spark, scoring.health(*map(F.lit, a)))
    assert health(100, True, True, True, 5000, 10) == 100 and health(0, False, False, False, 0, 1000) == 10
    status = lambda *a: one(spark, scoring.status(*[F.lit(x).cast("long") for x in a]))
    assert [status(2, 1, 500), status(9, None, 500), status(9, 91, 500), status(9, 366, 500), status(9, 1, 5)] == ["experimental", "active", "paused", "abandoned", "experimental"]


def test_capabilities(spark):
    signals = spark.createDataFrame([("p", ["fastapi", "redis", "langchain-community"], [], ["processPDFFile"], ["migrations", "tests"], "Rust"), ("q", ["preact-lite", "reactor"], None, [], [], None)], "project_id string, dependencies array<string>, frameworks array<string>, symbol_names array<string>, top_level_dirs array<string>, language string")
    found = capabilities.extract(signals, rules.capability_rules(spark)).collect()
    by = {(r.project_id, r.capability): r for r in found}
    assert {c for p, c in by if p == "p"} == {"Web API", "Caching", "RAG", "PDF Processing", "Schema Migration", "Testing", "Systems Programming"}
    assert not [c for p, c in by if p == "q"]
    assert by["p", "RAG"].implementation == "LangChain" and by["p", "Web API"].confidence == 0.8 and [r.confidence for r in found] == sorted((r.confidence for r in found), reverse=True)
    nodes = {r.id: r for r in capabilities.nodes(capabilities.extract(signals, rules.capability_rules(spark))).collect()}
    assert nodes["impl_rag_langchain"].parent_id == "cap_rag" and nodes["cap_rag"].parent_id == "cap_domain_ai"


def test_symbols():
    python = 'class Box:\n    """A box."""\n\n    def put(self, x):\n        self.x = x\n        return x\n\n\n# Opens it.\ndef open_box(b):\n    return b.put(1)\n\nLIMIT = 3\n'
    rows = {r[0]: r for r in symbols.extract("Python", "a.py", python)}
    assert [(r[1], r[4], r[6], r[7], r[8]) for r in rows.values()] == [("class", 1, "A box.", 9, None), ("method", 4, None, 6, "Box"), ("function", 10, "Opens it.", 3, None), ("constant", 13, None, 1, None)]
    assert rows["put"][9] and not rows["open_box"][9]
    js = "/** Lists. */\nexport async function list(req) {\n}\nconst Card = () => {\n}\napp.post('/items', h)\n"
    assert [(r[0], r[1]) for r in symbols.extract("TypeScript", "a.ts", js)] == [("list", "function"), ("Card", "component"), ("POST /items", "api_endpoint")]
    rust = "/// Runs.\npub(crate) async fn run() {\n}\nimpl Display for Thing {\n    fn fmt(&self) {\n    }\n}\n"
    assert [(r[0], r[1], r[6]) for r in symbols.extract("Rust", "a.rs", rust)] == [("run", "function", "Runs."), ("Thing", "type", None), ("fmt", "function", None)]
    assert [(r[0], r[1]) for r in symbols.extract("Java", "A.java", '@GetMapping("/x")\npublic class A {\n  public int size(List<String> xs) {\n  }\n}\n')] == [("GET /x", "api_endpoint"), ("A", "class"), ("size", "method")]
    assert [(r[0], r[1]) for r in symbols.extract("Go", "a.go", "type S struct {\n}\nfunc (s *S) Do() {\n}\nfunc main() {\n}\n")] == [("S", "struct"), ("Do", "method"), ("main", "function")]
    assert list(symbols.extract("Cobol", "x", "def f():")) == []


def test_manifests(spark):
    texts = [
        ("package.json", json.dumps({"dependencies": {"react": "1", "next": "2"}, "devDependencies": {"jest": "3"}})), ("Cargo.toml", '[dependencies]\naxum = "1"\n[dev-dependencies]\nproptest = "1"\n'),
        ("requirements.txt", "# c\nfastapi>=1\nllama_index[all]==2\n-r x\n"), ("go.mod", "module m\nrequire (\n github.com/gin-gonic/gin v1\n)\n"), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>spring-boot-starter-web</artifactId></dependency>"),
        ("pyproject.toml", "not [ toml"), ("Gemfile", "gem 'rails', '1'\n"), ("composer.json", '{"require": {"a/b": "1"}}'),
    ]
    deps = manifests.dependencies(spark.createDataFrame([("p", n, t.encode()) for n, t in texts], "project_id string, name string, content binary"))
    assert {(r.dependency, r.dev) for r in deps.collect()} == {("react", False), ("next", False), ("jest", True), ("axum", False), ("proptest", True), ("fastapi", False), ("llama_index[all]", False), ("github.com/gin-gonic/gin", False), ("g:spring-boot-starter-web", False), ("rails", False), ("a/b", False)}
    assert manifests.frameworks(deps, spark).first().frameworks == ["Next.js", "Spring Boot", "Axum", "FastAPI", "Gin", "LlamaIndex", "React"]


def test_projects_on_disk(spark, tmp_path):
    files = {
        "web/package.json": "{}", "web/README.md": "# Web\n\n[![b](c)](d)\nA small tool\nfor tests.\n\nMore.", "web/src/app.ts": "// c\nexport function go() {\n  return 1\n}\n", "web/node_modules/x/package.json": "{}", "web/api_token.ts": "const A = 1",
        "web/packages/inner/package.json": "{}", "notes/a.md": "x", "lib/Cargo.toml": "[dependencies]\n", "lib/src/main.rs": "fn main() {\n}\n", "lib/tests/t.rs": "// t",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    listing = projects.listing(spark, f"file://{tmp_path}")
    roots = projects.project_roots(listing, spark)
    assert {(r.dir, r.kind, r.has_readme, r.has_tests) for r in roots.collect()} == {("web", "node", True, False), ("lib", "rust", False, True)}
    owned = projects.assign(listing, roots)
    assert {(r.project_id, r.rel_path) for r in projects.source_files(owned).collect()} >= {("web", "web/src/app.ts"), ("lib", "lib/src/main.rs")}
    assert not [r for r in projects.source_files(owned).collect() if "node_modules" in r.rel_path or "token" in r.rel_path]
    assert [r.excerpt for r in projects.readmes(owned).collect()] == ["A small tool for tests."]
    assert {r.project_id: r.folders for r in projects.top_level(owned).collect()} == {"web": ["node_modules", "packages", "src"], "lib": ["src", "tests"]}
    assert {(r.project_id, r.name, r.loc) for r in projects.language_stats(owned).collect()} >= {("web", "TypeScript", 3), ("lib", "Rust", 2)} and projects.newest(owned).count() == 2
    names = {r.name for r in symbols.symbols(projects.source_files(owned)).collect()}
    assert {"go", "main"} <= names
    assert projects.drop_globs(listing, ["src/**", "*.md"]).where("rel_path LIKE '%.md' OR rel_path LIKE '%/src/%'").count() == 0
    assert one(spark, projects.count_lines(F.lit("a\n\n/* x\ny */\n# c\nb"))).asDict() == {"total": 6, "code": 2, "comment": 3, "blank": 1}
    log = spark.createDataFrame([("p", "a", "2024-05-31"), ("p", "b", "2020-01-01T00:00:00Z"), ("p", "a", "bad")], "project_id string, author string, date string")
    row = projects.commits(log, F.lit(NOW).cast("timestamp")).first()
    assert (row.commits, row.recent, row.authors) == (3, 1, 2)
    assert one(spark, projects.branch(F.lit("ref: refs/heads/main\n"))) == "main"


def test_merge(spark, tmp_path):
    old = spark.createDataFrame([("1", "a", "useful"), ("2", "b", None), (None, "n", "x")], "id string, name string, user_feedback string")
    new = spark.createDataFrame([("1", "A", None), ("3", "c", None), (None, "N", None)], "id string, name string, user_feedback string")
    store = handlers.Store(spark, f"file://{tmp_path}/t")
    store.replace("t", old)
    merged = store.merge("t", new, ["name"])
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([("1", "A", "useful"), ("2", "b", None), ("3", "c", None), (None, "N", "x")], key=str)
    again = merge.merge(merged, new, ["id"], ["name"])
    assert again.exceptAll(merged).count() == 0 == merged.exceptAll(again).count()
    opp = spark.createDataFrame([("a", "new"), ("b", "adopted")], "id string, status string")
    assert {r.id: r.status for r in merge.set_status(opp, spark.createDataFrame([("a", "explored"), ("b", "new")], "id string, status string")).collect()} == {"a": "explored", "b": "adopted"}
    assert {r.status for r in merge.dismiss_all(opp).collect()} == {"dismissed", "adopted"}


EVENTS = [("j", 1, "queued", None), ("j", 2, None, 0.4), ("j", 3, "completed", None), ("j", 4, "failed", 0.1), ("k", 5, "queued", 0.0), ("k", 6, None, 7.0), ("l", 7, "running", 0.2), ("l", 8, "cancelled", None), ("l", 9, "running", 0.9)]


def events(spark):
    rows = [(j, s, "scan", st, p, None, None, None, None, None) for j, s, st, p in EVENTS]
    return spark.createDataFrame(rows, jobs.EVENTS)


def test_job_log(spark, tmp_path):
    got = {r.job_id: (r.status, r.progress) for r in jobs.fold(events(spark)).collect()}
    assert got == {"j": ("completed", 1.0), "k": ("running", 1.0), "l": ("cancelled", 0.2)}
    assert got == {j: progress.step(None, [(s, st, p) for k, s, st, p in EVENTS if k == j])[:2] for j in got}
    ran = []
    stages = {"scan": lambda o, report: (report(0.5), ran.append("scan")), "index": lambda o, report: 1 / 0, "insight": lambda o, report: ran.append("insight")}
    runner = jobs.Runner(spark, f"file://{tmp_path}/log", stages)
    assert [x.split("-")[0] for x in runner.run("scan", '{"chain": true}')] == ["scan", "index"] and ran == ["scan"]
    assert {r.type: r.status for r in jobs.fold(runner.events()).collect()} == {"scan": "completed", "index": "failed"}
    runner.append("x", "scan", "running")
    with pytest.raises(jobs.Busy):
        runner.run("scan")


def test_stream_is_the_batch_fold(spark, tmp_path):
    source, sink = str(tmp_path / "in"), {}
    batch = events(spark)
    for half in (F.col("seq") <= 4, F.col("seq") > 4):
        batch.where(half).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = progress.serve(stream, lambda frame, _: sink.update({r.job_id: (r.status, r.progress) for r in frame.itertuples()}), str(tmp_path / "check"))
    want, end = {r.job_id: (r.status, r.progress) for r in jobs.fold(batch).collect()}, time.time() + 90
    try:  # timers make batches for ever, so the stream is never idle
        while sink != want and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sink == want


def test_graph_and_insights(spark):
    caps = spark.createDataFrame([("d", "AI", "domain", None, 1.0, 0)] + [(f"c{i}", n, "capability", "d", 0.9, 0) for i, n in enumerate(("Text Generation", "RAG", "Embedding"))], "id string, name string, layer string, parent_id string, confidence double, project_count int")
    projs = spark.createDataFrame([(f"p{i}", f"P{i}", "x", "paused", f"2024-0{i + 1}-01", None) for i in range(4)], "id string, name string, path string, status string, last_commit_at string, updated_at string")
    edges = spark.createDataFrame([(f"e{p}{c}", f"p{p}", "project", "implements", f"c{c}", "capability", 0.5 + p / 10) for p in range(4) for c in range(3) if (p + c) % 4], "id string, source_id string, source_type string, relation_type string, target_id string, target_type string, confidence double")
    assets = spark.createDataFrame([("a1", "p0", "embedding_cache", "code", ["x"], "a.py", 0.9, None, 0.8), ("a2", "p1", "other", "code", [], "b.py", 0.95, "useless", 0.5)], "id string, project_id string, name string, type string, tags array<string>, source_path string, reuse_score double, user_feedback string, generality double")
    tables = {"projects": projs, "capabilities": caps, "relations": edges, "assets": assets}
    found = {r.id: r for r in insights.detect_all(tables, F.lit(NOW).cast("timestamp")).collect()}
    assert {"ins_dup_c0", "ins_dup_c2", "ins_reuse_a1", "ins_dir_c0", "ins_combo_d"} <= set(found) and "ins_reuse_a2" not in found
    assert abs(found["ins_dup_c2"].confidence - (0.72 + 0.072 + 0.06)) < 1e-9 and found["ins_dup_c2"].asset_ids == ["a1"]
    opp = insights.opportunities({**tables, "capabilities": caps.withColumn("id", F.when(F.col("id") == "d", "cap_domain_ai").otherwise(F.col("id"))).withColumn("parent_id", F.when(F.col("parent_id") == "d", "cap_domain_ai"))}).first()
    assert opp.id == "opp_ai" and opp.coverage == 0.3 and len(opp.missing_capabilities) == 7 and opp.rating == 3
    names, weights = graph.labels(caps, projs, assets), caps.select(F.col("id").alias("node"), F.col("project_count").alias("weight"))
    view = graph.assemble(graph.focus(edges, "p1", expand=True), edges, names, weights, 4)
    nodes = {r.node for r in view["nodes"].collect()}
    assert all({r.source_id, r.target_id} <= nodes for r in view["edges"].collect())
    assert graph.parse_list("domain, capability", "capability_layer") == ["domain", "capability"] and graph.parse_list(" ", "capability_layer") is None
    with pytest.raises(ValueError):
        graph.parse_list("odd", "capability_layer")
