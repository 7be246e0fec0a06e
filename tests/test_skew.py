"""Hot names meet by blocks; detectors gather only what they keep."""

import random

from pyspark.sql import functions as F

from forgelens.operators import capabilities, insights


def test_hot_names_by_blocks(spark):
    rng = random.Random(3)
    rows = [("utils", f"p{i}", 0.5) for i in range(120)] + [(f"n{rng.randrange(40)}", f"p{rng.randrange(60)}", rng.random()) for _ in range(600)] + [("Utils", "p1", 0.9), ("alone", "p1", 1.0)]
    df = spark.createDataFrame(rows, "name string, project_id string, reuse_score double")
    whole = {(r.a, r.b): (round(r.confidence, 9), r.names) for r in capabilities.similar_pairs(df, block=1000).collect()}
    split = {(r.a, r.b): (round(r.confidence, 9), r.names) for r in capabilities.similar_pairs(df, block=7).collect()}
    assert split == whole and len(whole) == 120 * 119 // 2
    # The groups that meet: none holds more than some of the name's projects on either side.
    members = df.select(F.lower("name").alias("key"), F.col("project_id").alias("p")).distinct().where("key = 'utils'")
    largest = members.groupBy(F.pmod(F.xxhash64("p"), F.lit(18))).count().agg(F.max("count")).first()[0]
    assert largest < 20


def test_nothing_is_gathered_above_the_limit(spark):
    caps = spark.createDataFrame([("d", "D", "domain", None, 1.0)] + [(f"c{i:02d}", f"Cap {i}", "capability", "d", 0.9) for i in range(30)], "id string, name string, layer string, parent_id string, confidence double")
    projects = spark.createDataFrame([(f"p{i:02d}", f"P{i}", "active", "2024-05-01", None) for i in range(40)], "id string, name string, status string, last_commit_at string, updated_at string")
    edges = spark.createDataFrame([(f"p{p:02d}", "implements", f"c{c:02d}") for c in range(30) for p in range(c + 2)], "source_id string, relation_type string, target_id string")
    assets = spark.createDataFrame([(f"a{i:03d}", f"p{i % 40:02d}", f"capper {i}", "code", ["x"], f"f{i:03d}.py", 0.9, None) for i in range(200)], "id string, project_id string, name string, type string, tags array<string>, source_path string, reuse_score double, user_feedback string")
    tables = {"projects": projects, "capabilities": caps, "relations": edges, "assets": assets.withColumn("name", F.concat(F.lit("Cap "), F.col("id")))}
    found = insights.duplicate_capabilities(tables)
    rows = found.collect()
    assert [r.id for r in rows] == [f"ins_dup_c{i:02d}" for i in range(29, 19, -1)]
    for r in rows:
        n = int(r.id[-2:]) + 2
        assert r.project_ids == [f"p{i:02d}" for i in range(n)]
        assert sum(e.kind == "file" for e in r.evidence) in (0, 8) and sum(e.kind == "project" for e in r.evidence) == n
    now = F.lit("2024-06-01").cast("timestamp")
    assert [r.id for r in insights.tech_directions(tables, now).collect()][:2] == ["ins_dir_c29", "ins_dir_c28"]
    for df in (found, insights.tech_directions(tables, now), insights.combination_hints(tables)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for i, line in enumerate(lines := plan.splitlines()):
            if "collect_list" in line:  # every list is of a join with what a limit left
                assert any("LocalLimit" in below or "GlobalLimit" in below for below in lines[i:])


def test_opportunities_gather_no_sets(spark):
    """Projects and names of a domain are made distinct by plain aggregates, and lists of
    projects are not sent through the driver."""
    n = 300
    tables = {
        "projects": spark.range(n).select(F.concat(F.lit("p"), "id").alias("id")),
        "capabilities": spark.createDataFrame([("d", "Domain", "domain", None, 1.0), *[(f"c{i}", f"Name {i // 2}", "capability", "d", 1.0) for i in range(8)]], "id string, name string, layer string, parent_id string, confidence double"),
        "assets": spark.range(10).select(F.concat(F.lit("a"), "id").alias("id"), F.concat(F.lit("p"), F.col("id") * 2).alias("project_id"), F.lit("code").alias("type"), (F.col("id") / 10).alias("reuse_score"), F.lit(None).cast("string").alias("user_feedback")),
        "relations": spark.range(n * 8).select(F.concat(F.lit("p"), (F.col("id") / 8).cast("long")).alias("source_id"), F.lit("implements").alias("relation_type"), F.concat(F.lit("c"), F.col("id") % 8).alias("target_id")),
    }
    out = insights.opportunities(tables)
    row = out.first()
    assert (len(row.source_project_ids), row.source_asset_ids, row.required_capabilities, row.rating) == (n, ["a7", "a8", "a9"], [f"Name {i}" for i in range(4)], 4)
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
