"""Pages and details: what a client shows, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enums
from ..functions import scalars as S
from ..operators import relational
from . import jobs

Tables = dict[str, DataFrame]


def _idle(now: Column) -> Column:
    return S.idle_days(F.col("last_commit_at").cast("timestamp"), F.col("updated_at").cast("timestamp"), now)


def project_list(tables: Tables, now: Column, sort: str = "recent", limit: int | None = None, offset: int = 0, **filters) -> dict[str, DataFrame]:
    """items, the true total, and facets; facets do not depend on the filters."""
    found = relational.filter_projects(tables["projects"], **filters)
    items = relational.page(found, "project", relational.order(f"project.{sort}"), limit, offset)
    spark = items.sparkSession
    return {
        "items": items.withColumns({"idle": _idle(now), "age": S.relative_time(S.parse_time(F.col("updated_at").cast("string")), now), "size_text": S.format_count(F.col("loc"))}),
        "total": found.agg(F.count("*").alias("total")),
        "languages": relational.distribution(tables["projects"], "language"),
        "statuses": relational.facet(tables["projects"], "status", enums.lookup(spark, "project_status").where("value <> 'unknown'")),
    }


def project_detail(tables: Tables, project: str) -> dict[str, DataFrame]:
    """The project with its capabilities, neighbours, best assets and insights."""
    caps = tables["capabilities"]
    domains = caps.select(F.col("id").alias("parent_id"), F.col("name").alias("domain"))
    edges = tables["relations"].where((F.col("source_id") == project) & (F.col("relation_type") == "implements")).select(F.col("target_id").alias("id"), F.col("confidence").alias("edge_confidence"))
    similar = relational.similar_projects(tables["relations"], project).select(F.col("other_id").alias("id"), "confidence", "evidence")
    return {
        "project": tables["projects"].where(F.col("id") == project),
        "capabilities": edges.join(caps, "id").join(domains, "parent_id", "left").select("id", "name", "domain", F.col("edge_confidence").alias("confidence")).orderBy(F.col("confidence").desc(), "name"),
        "similar": similar.join(tables["projects"].select("id", "name"), "id").orderBy(F.col("confidence").desc(), "id"),
        "assets": relational.top(tables["assets"].where(F.col("project_id") == project), relational.order("asset.reuse"), 8),
        "insights": tables["insights"].where(F.array_contains("project_ids", project)).orderBy(F.col("confidence").desc(), "id").limit(5),
    }


def archaeology(project: DataFrame, assets: DataFrame, now: Column) -> DataFrame:
    """The story of projects with commits: how long they rest, and what is worth saving."""
    best = relational.top_per(assets, ["project_id"], [F.col("reuse_score").desc(), F.col("name")], 3).groupBy(F.col("project_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("salvage"))
    told = project.where("has_git AND git_commits > 0").join(best, "id", "left")
    text = F.concat_ws(" ", F.format_string("%s has %d commits.", "name", "git_commits"), F.when(_idle(now) > 180, F.format_string("It rests for %d days.", _idle(now))), F.when(F.col("salvage").isNotNull(), F.concat(F.lit("Worth saving: "), F.col("salvage"), F.lit("."))))
    return told.select("id", text.alias("narrative"))


def asset_list(tables: Tables, sort: str = "reuse", limit: int | None = None, offset: int = 0, types: Sequence[str] | None = None, **filters) -> dict[str, DataFrame]:
    """The type facet is counted without the type filter and has all types."""
    base = relational.filter_assets(tables["assets"], **filters)
    found = relational.one_of(base, "type", types or None)
    names = tables["projects"].select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    items = relational.page(found, "asset", relational.order(f"asset.{sort}"), limit, offset).join(names, "project_id", "left")
    return {"items": items.withColumns({"project_name": F.coalesce("project_name", F.lit("(removed project)")), "tier": enums.reuse_tier(F.col("reuse_score"))}), "total": found.agg(F.count("*").alias("total")), "types": relational.facet(base, "type", enums.lookup(items.sparkSession, "asset_type"))}


def duplicates_of(assets: DataFrame, projects: DataFrame, asset: str) -> DataFrame:
    """Assets of the same type and name, other than itself."""
    me = assets.where(F.col("id") == asset).select("type", "name")
    return assets.where(F.col("id") != asset).join(F.broadcast(me.limit(1)), ["type", "name"], "left_semi").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")


def insight_list(tables: Tables, limit: int | None = None, offset: int = 0, types: Sequence[str] | None = None, **filters) -> dict[str, DataFrame]:
    base = relational.filter_insights(tables["insights"], None, **filters)
    found = relational.one_of(base, "type", types or None)
    items = relational.page(found, "insight", relational.order("insight"), limit, offset)
    shown = items.withColumns({"badge": enums.insight_badge(F.col("confidence")), "state": F.coalesce("user_feedback", F.lit("pending")), "percent": S.percent(F.col("confidence"))})
    return {"items": shown, "total": found.agg(F.count("*").alias("total")), "types": relational.facet(base, "type", enums.lookup(items.sparkSession, "insight_type")), "adoption": relational.adoption_rate(tables["insights"])}


def related(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """``ids(ids array)`` as entities in order; what no longer exists is dropped."""
    return relational.hydrate(ids.select(F.posexplode("ids").alias("pos", "id")), entities)


def opportunity_list(tables: Tables, limit: int | None = None, offset: int = 0, **filters) -> dict[str, DataFrame]:
    found = relational.filter_opportunities(tables["opportunities"], **filters)
    items = relational.page(found, "opportunity", relational.order("opportunity"), limit, offset)
    return {"items": items.withColumns({"stars": S.stars(F.col("rating")), "percent": S.percent(F.col("coverage"))}), "total": found.agg(F.count("*").alias("total")), "statuses": relational.facet(tables["opportunities"], "status", enums.lookup(items.sparkSession, "opportunity_status"))}


def empty_hint(total: int, unfiltered: int) -> str | None:
    """Why a list is empty: there is nothing yet, or the filters leave nothing."""
    return None if total else "nothing matches these filters" if unfiltered else "nothing has been found yet; run a scan"


def current_job(states: DataFrame) -> DataFrame:
    """The job that runs, else the most recent one."""
    return jobs.view(states).orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.col("updated_at").desc(), "job_id").limit(1)


def dashboard(tables: Tables, now: Column) -> dict[str, DataFrame]:
    counts = relational.table_counts({k: tables[k] for k in ("projects", "assets", "capabilities", "insights", "opportunities") if k in tables})
    scan = tables["projects"].agg(F.max(F.nullif("scanned_at", F.lit(""))).alias("last_scan"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc")) if "scanned_at" in tables["projects"].columns else None
    return {
        "counts": counts, "reusable": tables["assets"].agg(F.count_if(F.col("reuse_score") >= 0.70).alias("reusable")),
        "capabilities": tables["capabilities"].where("layer = 'capability'").orderBy(F.col("project_count").desc(), "name").limit(6),
        "insights": relational.page(tables["insights"], "insight", relational.order("insight"), 4), "opportunities": opportunity_list(tables, 3)["items"], **({"scan": scan} if scan is not None else {}),
    }


def onboarding(directories: int, projects: int, assets: int, model_calls: int) -> dict[str, bool]:
    """The steps that are done; hidden when the first three are."""
    steps = {"directory": directories > 0, "scan": projects > 0, "index": assets > 0, "model": model_calls > 0}
    return steps | {"hidden": steps["directory"] and steps["scan"] and steps["index"]}


class Settings:
    """Key and value rows; a later row of a key replaces the earlier ones."""

    SCHEMA = "key string, value string, sensitive boolean, seq long"

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def empty(cls, spark: SparkSession) -> Settings:
        return cls(spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in cls.SCHEMA.split(", ")]))

    def save(self, values: dict[str, str], sensitive: Sequence[str] = ()) -> Settings:
        new = self.rows.sparkSession.createDataFrame([(k, v, k in sensitive) for k, v in values.items()], "key string, value string, sensitive boolean")
        last = self.rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        return Settings(self.rows.unionByName(new.withColumn("seq", F.lit(last + 1))))

    def current(self) -> DataFrame:
        return relational.latest(self.rows, ["key"], ["seq"])

    def shown(self) -> DataFrame:
        return self.current().select("key", F.when(F.col("sensitive"), S.mask_key(F.col("value"))).otherwise(F.col("value")).alias("value"))

    def export(self) -> DataFrame:
        return self.current().where(~F.col("sensitive")).select("key", "value").orderBy("key")


def add_directory(paths: list[str], path: str) -> list[str]:
    """Without repeats, by the path with forward slashes and no slash at the end."""
    clean = lambda p: p.strip().replace("\\", "/").rstrip("/") or "/"
    return list(dict.fromkeys([*map(clean, paths), clean(path)]))
