"""Details of single rows, stored analyses, graph helpers, and texts about a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enums
from ..functions import scalars as S
from ..operators import insights, ranking, relational
from . import views

Tables = dict[str, DataFrame]
#: What a stored analysis holds, and a profile.
ANALYSIS = "parts array<struct<name:string,note:string>>, scaffold array<string>, mvp string"
PROFILE = "summary string, strengths array<string>, risks array<string>, files array<string>, assets array<string>, trust double"
GONE = "(removed project)"


def capability_count(capabilities: DataFrame) -> DataFrame:
    """One row: how many capabilities there are, domains and implementations aside."""
    return capabilities.agg(F.count_if(F.col("layer") == "capability").alias("n"))


def stored_analysis(opportunities: DataFrame, schema: str = ANALYSIS) -> DataFrame:
    """id, analysis of those that have one: null and blank are none. A text that is not what
    was stored is an error, unlike in other JSON columns."""
    text = S.non_empty(F.col("analysis_json"))
    bad = ~F.startswith(text, F.lit("{")) | F.get_json_object(text, "$").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("corrupt analysis of "), F.col("id").cast("string"))).cast("string")).otherwise(text)
    return opportunities.where(text.isNotNull()).select("id", F.from_json(checked, schema).alias("analysis"))


def structure(files: DataFrame) -> dict[str, DataFrame]:
    """Of the files of projects (see projects.assign): what stands at their top, their
    languages with whole percentages that sum to 100, and their numbers of files."""
    from ..sources import projects

    stats = projects.language_stats(files)
    return {
        "top": projects.top_level(files),
        "languages": relational.language_shares(stats),
        "counts": stats.groupBy("project_id").agg(F.sum("files").alias("files"), F.sum("loc").alias("loc")),
    }


def project_detail(tables: Tables, project: str, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """views.project_detail, with the profile that a model wrote (null where there is none or
    it cannot be read) and, given the project's files, its structure."""
    out = views.project_detail(tables, project)
    rows = out["project"]
    text = F.col("ai_profile") if "ai_profile" in rows.columns else F.lit(None).cast("string")
    out["profile"] = rows.select("id", F.from_json(S.non_empty(text), PROFILE).alias("p")).where("p IS NOT NULL").select("id", "p.*")
    return out | (structure(files) if files is not None else {})


def asset_detail(tables: Tables, asset: str) -> dict[str, DataFrame]:
    """The asset with its tier and its project's name, its evidence as rows, its like-named
    others, and the capabilities of its project that its name or tags mention."""
    row = tables["assets"].where(F.col("id") == asset)
    names = tables["projects"].select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    shown = row.join(names, "project_id", "left").withColumns({"project_name": F.coalesce("project_name", F.lit(GONE)), "tier": enums.reuse_tier(F.col("reuse_score")), "percent": S.percent(F.col("confidence"))})
    kinds = [c for c in ("files", "commits", "functions") if c in row.schema["evidence"].dataType.names]
    evidence = row.select("id", F.explode(F.flatten(F.array(*[_tagged(c) for c in kinds]))).alias("e")).select("id", "e.kind", "e.label")
    implemented = tables["relations"].where("relation_type = 'implements'").join(row.select(F.col("project_id").alias("source_id"), F.col("name").alias("asset_name"), "tags"), "source_id")
    known = implemented.select(F.col("target_id").alias("id"), "asset_name", F.col("tags").alias("asset_tags")).join(tables["capabilities"].select("id", F.col("name").alias("capability")), "id")
    mentioned = known.where(insights._mentions(F.col("asset_name"), F.col("asset_tags"), F.col("capability"))).select("id", "capability").orderBy("capability", "id")
    return {"asset": shown, "evidence": evidence, "duplicates": views.duplicates_of(tables["assets"], tables["projects"], asset), "capabilities": mentioned}


def _tagged(kind: str) -> Column:
    """A list of the evidence, each with what it is."""
    return F.transform(F.coalesce(F.col(f"evidence.{kind}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind.rstrip("s")).alias("kind"), x.alias("label")))


def insight_detail(tables: Tables, insight: str) -> dict[str, DataFrame]:
    """The insight with badge, percent and state; its projects and assets in its order, without
    those that are gone; and what else was found on the same projects."""
    row = tables["insights"].where(F.col("id") == insight)
    shown = row.withColumns({"badge": enums.insight_badge(F.col("confidence")), "state": F.coalesce("user_feedback", F.lit("pending")), "percent": S.percent(F.col("confidence"))})
    others = tables["insights"].where(F.col("id") != insight).join(F.broadcast(row.select(F.col("project_ids").alias("mine")).limit(1)), F.arrays_overlap("project_ids", "mine")).drop("mine")
    of = lambda c, t: views.related(row.select(F.col(c).alias("ids")), tables[t])
    return {"insight": shown, "projects": of("project_ids", "projects"), "assets": of("asset_ids", "assets"), "related": others.orderBy(F.col("confidence").desc(), "id").limit(5)}


def migration_note(generality: Column) -> Column:
    return F.when(generality >= 0.8, "use as it is").when(generality >= 0.6, "adapt its interface").otherwise("separate it from its project first")


def deep_analysis(opportunity: DataFrame, assets: DataFrame) -> DataFrame:
    """id, parts, scaffold, mvp of opportunities: each reusable asset, best first, with what
    moving it takes; the folders to begin with, one for each covered capability; and what
    a first version does and lacks."""
    parts = insights.analyse(opportunity, assets)
    slug = lambda c: F.concat(F.lit("src/"), S.slug(c), F.lit("/"))
    scaffold = F.concat(F.array(F.lit("README.md")), F.transform("required_capabilities", slug), F.array(F.lit("tests/")))
    first = F.array_join(F.slice("required_capabilities", 1, 3), ", ")
    lacks = F.when(F.size("missing_capabilities") == 0, F.lit("Nothing is missing.")).otherwise(F.concat(F.lit("To be added: "), F.array_join("missing_capabilities", ", "), F.lit(".")))
    mvp = F.concat(F.lit("A first version joins "), first, F.lit(" of "), F.size("source_project_ids").cast("string"), F.lit(" projects. "), lacks)
    return opportunity.join(parts, "id", "left").select("id", F.coalesce("parts", F.array().cast("array<struct<rank:int,name:string,note:string>>")).alias("parts"), scaffold.alias("scaffold"), mvp.alias("mvp"))


def opportunity_detail(tables: Tables, opportunity: str) -> dict[str, DataFrame]:
    """The opportunity with stars and percent, its projects and assets, and its analysis as
    stored (none: no rows)."""
    row = tables["opportunities"].where(F.col("id") == opportunity)
    of = lambda c, t: views.related(row.select(F.col(c).alias("ids")), tables[t])
    stored = stored_analysis(row) if "analysis_json" in row.columns else row.limit(0).select("id")
    return {"opportunity": row.withColumns({"stars": S.stars(F.col("rating")), "percent": S.percent(F.col("coverage"))}), "projects": of("source_project_ids", "projects"), "assets": of("source_asset_ids", "assets"), "analysis": stored}


def search_view(hits: DataFrame, total: DataFrame, text: str, unfiltered: int | None = None, **filters) -> dict[str, DataFrame | dict | str | None]:
    """A search as a client shows it: items, total, the filters that were applied (blank ones
    were not), counts by kind, and why there is nothing."""
    applied = {k: v for k, v in filters.items() if v is not None and v != [] and str(v).strip()}
    n = total.first()["total"]
    hint = views.empty_hint(n, n if unfiltered is None else unfiltered) if text.strip() or applied else views.empty_hint(n, 0)
    return {"items": ranking.api_view(hits), "total": total, "applied": applied, "kinds": relational.kind_counts(hits), "hint": hint}


# The graph


def capability_weights(capabilities: DataFrame, relations: DataFrame) -> DataFrame:
    """node, weight: how many projects implement a capability."""
    return relational.project_counts(capabilities, relations).select(F.col("id").alias("node"), F.col("project_count").alias("weight"))


def graph_summary(stats: DataFrame) -> DataFrame:
    """One row of text for the stats of graph.assemble."""
    part = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, F.col(c).cast("long")))
    return stats.select(F.concat_ws(", ", F.format_string("%d nodes", F.col("nodes").cast("long")), F.format_string("%d edges", F.col("edges").cast("long")), part("omitted", "%d not shown"), part("dangling", "%d to what is not here"), part("isolated", "%d alone")).alias("summary"))


def project_subtitle(language: Column, files: Column, loc: Column, millions: bool = True) -> Column:
    return F.concat_ws(" · ", S.non_empty(language), F.when(files > 0, F.concat(files.cast("string"), F.lit(" files"))), F.when(loc > 0, F.concat(S.format_count(loc, millions), F.lit(" lines"))))


def page_link(kind: Column, node: Column) -> Column:
    """Where a node's page is; kinds without pages: null."""
    pages = {"project": "/projects/", "capability": "/capabilities/", "asset": "/assets/", "insight": "/insights/", "opportunity": "/opportunities/"}
    return F.coalesce(*[F.when(kind == k, F.concat(F.lit(p), node)) for k, p in pages.items()])


# Texts about a project


def profile_prompt(projects: DataFrame, assets: DataFrame, capabilities: DataFrame, most: int = 12) -> DataFrame:
    """id, prompt: the facts of each project that a model may use. ``capabilities(project_id,
    name, confidence)``. At most ``most`` assets and capabilities, the best first."""
    line = lambda c: F.concat(F.lit("- "), c)
    best = relational.top_per(assets, ["project_id"], [F.col("reuse_score").desc(), F.col("name"), F.col("id")], most).groupBy(F.col("project_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("reuse_score")).alias("o"), "name", F.col("id").alias("i")))), lambda x: line(F.concat(x["name"], F.lit(" ["), x["i"], F.lit("]")))), "\n").alias("a"))
    able = relational.top_per(capabilities, ["project_id"], [F.col("confidence").desc(), F.col("name")], most).groupBy(F.col("project_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "name"))), lambda x: line(x["name"])), "\n").alias("c"))
    met = projects.join(best, "id", "left").join(able, "id", "left")
    head = F.concat_ws("\n", F.concat(F.lit("Project: "), F.col("name")), F.concat(F.lit("Language: "), S.non_empty(F.col("language"))), F.format_string("Lines: %d", F.coalesce("loc", F.lit(0)).cast("long")))
    return met.select("id", F.concat_ws("\n\n", head, F.concat(F.lit("Capabilities:\n"), F.col("c")), F.concat(F.lit("Assets:\n"), F.col("a")), F.lit("Name only what stands above, by its id in brackets.")).alias("prompt"))


def plain_profile(projects: DataFrame, assets: DataFrame, now: Column) -> DataFrame:
    """id, summary, narrative of each project without a model."""
    n = assets.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("reuse_score") >= 0.7).alias("good"))
    met = projects.join(n, "id", "left")
    idle = S.idle_days(F.col("last_commit_at").cast("timestamp"), F.col("updated_at").cast("timestamp"), now)
    summary = F.concat_ws(" ", F.concat(F.col("name"), F.lit(":")), F.coalesce(S.non_empty(F.col("language")), F.lit("a project")), F.lit("with"), F.concat(S.format_count(F.coalesce("loc", F.lit(0)).cast("long")), F.lit(" lines.")))
    rest = F.when(idle.isNull(), F.lit("Nothing is known of its last change.")).when(idle <= 90, F.lit("It is being worked on.")).otherwise(F.concat(F.lit("It rests for "), idle.cast("string"), F.lit(" days.")))
    worth = F.when(F.coalesce("good", F.lit(0)) > 0, F.concat(F.col("good").cast("string"), F.lit(" of its "), F.col("n").cast("string"), F.lit(" assets can be used elsewhere."))).otherwise(F.lit("Nothing of it stands out for reuse."))
    return met.select("id", summary.alias("summary"), F.concat_ws(" ", rest, worth).alias("narrative"))


def follow_ups(hits: DataFrame, most: int = 3) -> DataFrame:
    """place, question: what to ask next, by the kinds of the best hits."""
    ask = {"project": "What can be reused from {}?", "asset": "Where else is {} used?", "capability": "Which projects implement {}?", "insight": "What follows from: {}?", "opportunity": "What is missing for {}?"}
    text = F.coalesce(*[F.when(F.col("kind") == k, F.concat(F.lit(q.split("{}")[0]), F.col("title"), F.lit(q.split("{}")[1]))) for k, q in ask.items()])
    best = ranking.per_kind(hits.where(F.col("kind").isin(list(ask))), 1).orderBy(F.col("score").desc(), "id").limit(most)
    return best.select(F.row_number().over(ranking.Window.orderBy(F.col("score").desc(), "id")).alias("place"), text.alias("question")).orderBy("place")


def folders(spark: SparkSession, path: str, hidden: bool = False, most: int = 500) -> tuple[DataFrame, bool]:
    """(name, path of the folders one level below, by name whatever the case; whether there
    are more than ``most``)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        raise FileNotFoundError(path)
    found = sorted(((s.getPath().getName(), f"{path.rstrip('/')}/{s.getPath().getName()}") for s in fs.listStatus(root) if s.isDirectory() and (hidden or not s.getPath().getName().startswith("."))), key=lambda x: (x[0].lower(), x[0]))
    return spark.createDataFrame(found[:most], "name string, path string"), len(found) > most


def dashboard(tables: Tables, now: Column, activities: int = 6) -> dict[str, DataFrame]:
    """views.dashboard with the newest activities, and the onboarding facts as one row."""
    out = views.dashboard(tables, now)
    if "activities" in tables:
        out["activities"] = relational.recent(tables["activities"], "activity", activities)
    return out


def tags(assets: DataFrame, most: int | None = None, column: str = "tags") -> DataFrame:
    """The tag cloud in its order: by count, then tag; at most ``most``."""
    found = relational.tag_cloud(assets, column).orderBy(F.col("n").desc(), "tag")
    return found if most is None else found.limit(max(0, most))
