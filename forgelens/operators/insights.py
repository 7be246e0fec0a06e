"""Detectors of insights, and opportunities of domains, over the analysed tables.

``tables``: projects(id, name, path, status, last_commit_at, updated_at), assets(id,
project_id, name, type, tags, source_path, reuse_score, user_feedback), capabilities(id,
name, layer, parent_id, confidence), relations(source_id, relation_type, target_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.enums import insight_badge
from ..functions.scalars import clamp, idle_days
from ..sources.tables import staged

FLOOR, MOST = 0.55, 10
COLUMNS = ["id", "type", "title", "confidence", "project_ids", "asset_ids", "evidence", "tags"]


def empty_list() -> Column:
    return F.array().cast("array<string>")


def evidence(kind: str, label: Column, target: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), label.alias("label"), target.alias("target"))


def edges(tables: dict[str, DataFrame]) -> DataFrame:
    """capability, project: distinct implements edges of known capabilities. Where ``tables``
    has them as ``edges`` already, those."""
    if "edges" in tables:
        return tables["edges"]
    implements = tables["relations"].where("relation_type = 'implements'").select(F.col("target_id").alias("capability"), F.col("source_id").alias("project")).distinct()
    return implements.join(tables["capabilities"].where("layer = 'capability'").select(F.col("id").alias("capability"), F.col("name").alias("capability_name"), "parent_id", F.col("confidence").alias("capability_confidence")), "capability")


def with_idle(projects: DataFrame, now: Column) -> DataFrame:
    return projects.withColumn("idle", idle_days(F.col("last_commit_at").cast("timestamp"), F.col("updated_at").cast("timestamp"), now))


def _mentions(asset: Column, tags: Column, capability: Column) -> Column:
    """Whether the asset's name or tags hold a word of four letters or more of the name; of
    a name without such words, the whole name must stand in the asset's."""
    words = F.filter(F.split(F.lower(capability), r"\s+"), lambda w: F.length(w) >= 4)
    inside = lambda w: F.contains(F.lower(asset), w) | F.exists(tags, lambda t: F.contains(F.lower(t), w))
    return F.when(F.size(words) == 0, F.contains(F.lower(asset), F.lower(capability))).otherwise(F.exists(words, inside))


def _capped(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(MOST)


def _lists(found: DataFrame, keys: list[str], first: DataFrame, **lists: Column) -> DataFrame:
    """``first``, of a few rows, with lists of what ``found`` has of its keys: nothing is
    gathered of the others. The lists are sorted."""
    few = F.broadcast(first.select(*keys))
    gathered = found.join(few, keys, "left_semi").groupBy(*keys).agg(*[F.array_sort(F.collect_list(c)).alias(name) for name, c in lists.items()])
    return first.join(gathered, keys, "left")  # few rows, but their lists grow: none goes through the driver


def duplicate_capabilities(tables: dict[str, DataFrame], least: int = 2) -> DataFrame:
    """Capabilities that several projects implement, whose confidence is known (from 0 to 1).
    The ten of most projects are chosen by counts; projects, assets and at most eight files
    are gathered for those alone."""
    known = edges(tables).join(tables["projects"].select(F.col("id").alias("project"), F.col("name").alias("project_name")), "project", "left")
    counted = edges(tables).groupBy("capability", "capability_name", "capability_confidence").agg(F.count("*").alias("n")).where((F.col("n") >= max(2, least)) & F.col("capability_confidence").isNotNull())
    first = _capped(counted, [F.col("n").desc(), F.col("capability")])
    grouped = _lists(known, ["capability"], first, project_ids=F.col("project"), who=evidence("project", F.coalesce("project_name", "project"), F.col("project")))
    owned = tables["assets"].select(F.col("id").alias("asset"), F.col("project_id").alias("project"), F.col("name").alias("asset_name"), "tags", "source_path")
    mentions = edges(tables).join(F.broadcast(first.select("capability")), "capability", "left_semi").join(owned, "project").where(_mentions(F.col("asset_name"), F.col("tags"), F.col("capability_name"))).select("capability", "asset", evidence("file", F.col("source_path"), F.concat_ws(":", "project", "source_path")).alias("file"))
    rank = F.row_number().over(Window.partitionBy("capability").orderBy("file"))
    files = mentions.withColumn("_n", rank).where(F.col("_n") <= 8).groupBy("capability").agg(F.array_sort(F.collect_list("file")).alias("where"))
    assets = mentions.groupBy("capability").agg(F.array_sort(F.collect_set("asset")).alias("asset_ids"))
    met = grouped.join(F.broadcast(files), "capability", "left").join(F.broadcast(assets), "capability", "left")
    hits = F.coalesce(F.size("asset_ids"), F.lit(0))
    base = F.when(F.col("n") == 2, 0.60).when(F.col("n") == 3, 0.72).when(F.col("n") == 4, 0.80).otherwise(0.86)
    confidence = F.least(base + F.col("capability_confidence") * 0.08 + F.when(hits > 0, 0.06).otherwise(0.0), F.lit(0.96))
    out = met.select(
        F.concat(F.lit("ins_dup_"), F.col("capability")).alias("id"), F.lit("duplicate_capability").alias("type"), F.format_string("%s is implemented in %d projects", "capability_name", "n").alias("title"),
        confidence.alias("confidence"), "project_ids", F.coalesce("asset_ids", empty_list()).alias("asset_ids"),
        F.when(F.col("where").isNull(), F.col("who")).otherwise(F.concat("who", "where")).alias("evidence"), F.array("capability_name").alias("tags"), "n", "capability",
    )
    return _capped(out.where(F.col("confidence") >= FLOOR), [F.col("n").desc(), F.col("capability")]).select(COLUMNS)


def reusable_components(tables: dict[str, DataFrame], least: float = 0.80) -> DataFrame:
    """The best assets that nobody called useless; the cap comes before the floor."""
    assets = tables["assets"].where((F.col("reuse_score") >= least) & ~F.col("user_feedback").eqNullSafe("useless"))
    first = assets.orderBy(F.col("reuse_score").desc(), "name", "id").limit(MOST)
    out = first.select(
        F.concat(F.lit("ins_reuse_"), F.col("id")).alias("id"), F.lit("reusable_component").alias("type"), F.concat(F.col("name"), F.lit(" is ready for reuse")).alias("title"),
        F.col("reuse_score").alias("confidence"), F.array("project_id").alias("project_ids"), F.array("id").alias("asset_ids"), F.array(evidence("file", F.col("source_path"), F.concat_ws(":", "project_id", "source_path"))).alias("evidence"), F.col("tags"),
    )
    return out.where(F.col("confidence") >= FLOOR)


def forgotten_confidence(idle: Column, score: Column) -> Column:
    return F.least(F.when(idle >= 730, 0.55).when(idle >= 365, 0.45).otherwise(0.32) + 0.35 * score, F.lit(0.85))


def forgotten_assets(tables: dict[str, DataFrame], now: Column, idle: int = 180, least: float = 0.70) -> DataFrame:
    """Good assets without feedback in projects that rest, but are not abandoned."""
    resting = with_idle(tables["projects"], now).where((F.coalesce("idle", F.lit(1 << 40)) >= idle) & (F.col("status") != "abandoned")).select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), F.coalesce("idle", F.lit(1 << 40)).alias("idle"))
    found = tables["assets"].where((F.col("reuse_score") >= least) & F.col("user_feedback").isNull()).join(resting, "project_id")
    first = found.orderBy(F.col("idle").desc(), F.col("reuse_score").desc(), "id").limit(MOST)
    out = first.select(
        F.concat(F.lit("ins_forgot_"), F.col("id")).alias("id"), F.lit("forgotten_asset").alias("type"), F.concat(F.col("name"), F.lit(" rests in "), F.col("project_name")).alias("title"),
        forgotten_confidence(F.col("idle"), F.col("reuse_score")).alias("confidence"), F.array("project_id").alias("project_ids"), F.array("id").alias("asset_ids"),
        F.array(evidence("file", F.col("source_path"), F.concat_ws(":", "project_id", "source_path"))).alias("evidence"), F.col("tags"),
    )
    return out.where(F.col("confidence") >= FLOOR)


def tech_directions(tables: dict[str, DataFrame], now: Column, window: int = 180, least: int = 3) -> DataFrame:
    """Capabilities of several projects that moved within the window; projects are gathered
    for the ten that are left."""
    active = with_idle(tables["projects"], now).where(F.col("idle") <= window).select(F.col("id").alias("project"), F.col("name").alias("project_name"))
    moved = edges(tables).join(active, "project")
    total = active.agg(F.count("*").alias("total"))
    # One row with the total meets the few capabilities that are left.
    met = moved.groupBy("capability", "capability_name").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").where(F.col("total") >= least)
    rated = met.withColumn("confidence", F.least(0.55 + F.col("n") / F.col("total") * 0.35, F.lit(0.92))).where(F.col("confidence") >= FLOOR)
    first = _capped(rated, [F.col("n").desc(), F.col("capability")])
    listed = _lists(moved, ["capability"], first, project_ids=F.col("project"), evidence=evidence("project", F.col("project_name"), F.col("project")))
    out = listed.select(
        F.concat(F.lit("ins_dir_"), F.col("capability")).alias("id"), F.lit("tech_direction").alias("type"), F.concat(F.lit("A steady direction: "), F.col("capability_name")).alias("title"),
        "confidence", "project_ids", empty_list().alias("asset_ids"), "evidence", F.array("capability_name").alias("tags"), "n", "capability",
    )
    return _capped(out, [F.col("n").desc(), F.col("capability")]).select(COLUMNS)


def combination_hints(tables: dict[str, DataFrame], least: int = 3) -> DataFrame:
    """Domains with at least three projects and three implemented capabilities, chosen by
    counts of distinct ones."""
    domains = tables["capabilities"].where("layer = 'domain'").select(F.col("id").alias("parent_id"), F.col("name").alias("domain"))
    known = edges(tables).join(domains, "parent_id")
    counted = known.groupBy("parent_id", "domain").agg(F.count_distinct("project").alias("np"), F.count_distinct("capability_name").alias("nc")).where((F.col("np") >= least) & (F.col("nc") >= least))
    first = _capped(counted, [F.col("parent_id")])
    of = lambda c: known.select("parent_id", c).distinct()
    met = _lists(of("capability_name"), ["parent_id"], _lists(of("project"), ["parent_id"], first, project_ids=F.col("project")), names=F.col("capability_name"))
    who = F.transform(F.slice("project_ids", 1, 5), lambda p: evidence("project", p, p))
    what = F.transform(F.slice("names", 1, 4), lambda c: evidence("symbol", c, F.lit(None).cast("string")))
    out = met.select(
        F.concat(F.lit("ins_combo_"), F.col("parent_id")).alias("id"), F.lit("opportunity_hint").alias("type"), F.concat(F.col("domain"), F.lit(": capabilities that may be combined")).alias("title"),
        F.least(0.58 + F.least(F.size("names"), F.lit(6)) * 0.04, F.lit(0.88)).alias("confidence"), "project_ids", empty_list().alias("asset_ids"), F.concat(who, what).alias("evidence"), F.array("domain").alias("tags"), "parent_id",
    )
    return _capped(out.where(F.col("confidence") >= FLOOR), [F.col("parent_id")]).select(COLUMNS)


def detect_all(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """Every detector's insights, valid ones alone, by confidence, then id. The edges that the
    detectors share are made once, as a table in the shared folder."""
    tables = {**tables, "edges": staged(edges(tables), "edges")}
    parts = [duplicate_capabilities(tables), reusable_components(tables), forgotten_assets(tables, now), tech_directions(tables, now), combination_hints(tables)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    valid = (F.trim("title") != "") & (F.size("evidence") > 0) & (F.col("confidence") >= FLOOR)
    return out.where(valid).withColumn("badge", insight_badge(F.col("confidence"))).orderBy(F.col("confidence").desc(), "id")


def with_feedback(insights: DataFrame, before: DataFrame) -> DataFrame:
    """New insights with the feedback that their ids had."""
    return insights.drop("user_feedback").join(before.select("id", "user_feedback"), "id", "left")


def rating(projects: Column, coverage: Column, assets: Column) -> Column:
    p = F.when(projects <= 1, 0.0).when(projects == 2, 0.8).when(projects == 3, 1.2).when(projects == 4, 1.6).otherwise(2.0)
    a = F.when(assets <= 0, 0.0).when(assets == 1, 0.5).when(assets == 2, 0.9).when(assets == 3, 1.2).otherwise(1.4)
    return clamp(F.round(p + clamp(coverage, 0.0, 1.0) * 1.6 + a), 1, 5).cast("int")


def opportunities(tables: dict[str, DataFrame], complete: dict[str, list[str]] | None = None, least_projects: int = 2, least_capabilities: int = 2, least_coverage: float = 0.25, reusable: float = 0.70, most: int = 12) -> DataFrame:
    """One row a domain that projects cover in part: what is covered, what is missing."""
    complete = rules.COMPLETE if complete is None else complete
    key = F.regexp_replace("parent_id", "^cap_domain_", "")
    wanted = F.create_map(*[x for k, v in complete.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]) if complete else None
    domains = tables["capabilities"].where("layer = 'domain'").select(F.col("id").alias("parent_id"), F.col("name").alias("domain"))
    known = (edges(tables) if "edges" in tables else staged(edges(tables), "edges")).join(F.broadcast(domains), "parent_id")  # read twice
    # Projects and names are made distinct apart, by aggregates that combine before their
    # shuffle. A domain's capabilities are gathered, its projects are only counted here.
    members = staged(known.select("parent_id", "domain", F.col("project").alias("project_id")).distinct(), "members")
    named = known.select("parent_id", "capability_name").distinct().groupBy("parent_id").agg(F.array_sort(F.collect_list("capability_name")).alias("covered"))
    grouped = members.groupBy("parent_id", "domain").agg(F.count("project_id").alias("projects")).join(named, "parent_id")
    grouped = grouped.where((F.col("projects") >= least_projects) & (F.size("covered") >= least_capabilities))
    have = F.transform("covered", lambda c: F.lower(c))
    listed = F.coalesce(F.try_element_at(wanted, key), empty_list()) if wanted is not None else empty_list()
    missing = F.filter(F.col("listed"), lambda c: ~F.array_contains(F.col("have"), F.lower(c)))
    assets = tables["assets"].where((F.col("reuse_score") >= reusable) & ~F.col("user_feedback").eqNullSafe("useless") & (F.col("type") != "knowledge")).select("id", "project_id")
    met = grouped.withColumn("listed", listed).withColumn("have", have).withColumn("missing", missing)
    n = F.size("covered")
    coverage = F.when(F.size("listed") == 0, F.least(0.3 + n * 0.05, F.lit(0.6))).otherwise(F.round(n / (n + F.size("missing")), 2))
    ranked = met.withColumn("coverage", coverage).where(F.col("coverage") >= least_coverage)
    first = ranked.orderBy(F.col("coverage").desc(), F.col("projects").desc(), "parent_id").limit(most)
    members = members.select("parent_id", "project_id").distinct()  # a domain may stand under several names
    with_projects = _lists(members, ["parent_id"], first, project_ids=F.col("project_id"))
    owned = members.join(F.broadcast(first.select("parent_id")), "parent_id", "left_semi").join(assets, "project_id")
    met = _lists(owned, ["parent_id"], with_projects, asset_ids=F.col("id")).withColumn("asset_ids", F.coalesce("asset_ids", empty_list()))
    out = met.select(
        F.concat(F.lit("opp_"), key).alias("id"), F.concat(F.col("domain"), F.lit(": an opportunity to combine")).alias("title"), F.col("project_ids").alias("source_project_ids"), F.col("asset_ids").alias("source_asset_ids"),
        F.col("covered").alias("required_capabilities"), F.col("missing").alias("missing_capabilities"), "coverage", rating(F.size("project_ids"), F.col("coverage"), F.size("asset_ids")).alias("rating"), F.lit("new").alias("status"),
    )
    return out.orderBy(F.col("rating").desc(), F.col("coverage").desc(), "id")


def analyse(opportunity: DataFrame, assets: DataFrame) -> DataFrame:
    """The deep view of opportunities: each reusable asset with what moving it takes."""
    listed = opportunity.select("id", F.explode("source_asset_ids").alias("asset_id"))
    note = F.when(F.col("generality") >= 0.8, "use as it is").when(F.col("generality") >= 0.6, "adapt its interface").otherwise("separate it from its project first")
    parts = listed.join(assets.select(F.col("id").alias("asset_id"), "name", "reuse_score", "generality"), "asset_id").withColumn("note", note)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("reuse_score").desc(), "asset_id"))
    return parts.withColumn("rank", rank).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "note"))).alias("parts"))
