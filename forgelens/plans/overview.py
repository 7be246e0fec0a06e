"""The first page as tables: cards, a preview of the graph, what is new, steps to begin with; and
the breakdowns of the lists. One aggregate a table; no page holds more rows than it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enums
from ..functions import scalars as S
from ..operators import relational
from . import jobs

Tables = dict[str, DataFrame]
#: How many rows the page shows of each.
CAPABILITIES, INSIGHTS, OPPORTUNITIES, ACTIVITIES = 6, 4, 3, 6


def cards(tables: Tables) -> DataFrame:
    """key, value, detail, link, may_be_empty: one row a card. Capabilities are those of their layer
    alone. A detail of none is null, not "0"; that nothing was found is no fault of insights."""
    scanned = F.count(S.non_empty(F.col("scanned_at"))) if "scanned_at" in tables["projects"].columns else F.lit(0)
    none = F.lit(None).cast("long")
    facts = {
        "projects": (F.count("*"), scanned, " scanned", "projects", False),
        "assets": (F.count("*"), F.count_if(F.col("reuse_score") >= 0.70), " highly reusable", "assets", False),
        "capabilities": (F.count_if(F.col("layer") == "capability"), none, "", "graph", False),
        "insights": (F.count("*"), F.count_if(F.col("user_feedback").isNull()), " to be read", "insights", True),
    }
    out = None
    for place, (key, (value, part, text, link, empty)) in enumerate(facts.items()):
        counted = tables[key].agg(value.alias("value"), F.max(part).alias("part") if key == "capabilities" else part.alias("part"))
        detail = F.when(F.col("part") > 0, F.concat(F.col("part").cast("string"), F.lit(text)))
        row = counted.select(F.lit(place).alias("place"), F.lit(key).alias("key"), "value", detail.alias("detail"), F.lit(link).alias("link"), F.lit(empty).alias("may_be_empty"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy("place").drop("place")


def graph_size(tables: Tables) -> DataFrame:
    """nodes, edges: all layers, as the graph draws them; cards count one layer."""
    return tables["capabilities"].agg(F.count("*").alias("nodes")).join(F.broadcast(tables["relations"].agg(F.count("*").alias("edges"))), F.lit(True))  # one row each


def top_capabilities(capabilities: DataFrame, most: int = CAPABILITIES) -> DataFrame:
    """name, n: capabilities that most projects implement, from 1 to 100 of them."""
    found = capabilities.where("layer = 'capability'").orderBy(F.col("project_count").desc(), "name", "id")
    return found.limit(min(max(most, 1), 100)).select("name", F.col("project_count").alias("n"))


def insight_briefs(insights: DataFrame, most: int = INSIGHTS) -> DataFrame:
    found = relational.page(insights, "insight", relational.order("insight"), most)
    return found.select("id", "type", "title", "confidence", enums.insight_badge(F.col("confidence")).alias("badge"), *[c for c in ("description",) if c in insights.columns])


def opportunity_briefs(opportunities: DataFrame, most: int = OPPORTUNITIES) -> DataFrame:
    """The best that are neither dismissed nor adopted, with how much of each is there and
    how much is missing."""
    found = relational.page(relational.filter_opportunities(opportunities), "opportunity", relational.order("opportunity"), most)
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) if c in opportunities.columns else F.lit(0)
    return found.select("id", *[c for c in ("title", "description") if c in opportunities.columns], "rating", "coverage", size("source_asset_ids").alias("reusable"), size("missing_capabilities").alias("missing"))


def activity_briefs(activities: DataFrame, now: Column, most: int = ACTIVITIES) -> DataFrame:
    """The newest activities with how long ago they were. Logs without ``seq`` go by id."""
    log = activities if "seq" in activities.columns else activities.withColumn("seq", F.col("id"))
    found = relational.recent(log, "activity", most)
    return found.withColumn("when", S.relative_time(S.parse_time(F.col("created_at").cast("string")), now)).select(*activities.columns, "when")


def job_brief(states: DataFrame) -> DataFrame:
    """The running job that moved last, else the newest job: at most one row."""
    key = "job_id" if "job_id" in states.columns else "id"
    running = F.col("status") == "running"
    return jobs.view(states).orderBy(F.when(running, 0).otherwise(1), F.when(running, F.col("updated_at")).desc(), F.col("created_at").desc(), F.col(key).desc()).limit(1)


def steps(spark: SparkSession, projects: int, assets: int, scanned: bool, directories: int, model: bool) -> tuple[str | None, DataFrame]:
    """(headline, or None when all that is needed is done; step, done, action in order)."""
    rows = [
        ("directory", directories > 0, "add a directory"), ("scan", projects > 0 and scanned, "scan" if directories else "add a directory"),
        ("index", assets > 0, "index"), ("model", model, None),
    ]
    first = "Begin with a directory." if not directories else "The directory is there and has not been scanned." if not projects else "The projects are scanned and wait for the index."
    return None if all(done for _, done, _ in rows[:3]) else first, spark.createDataFrame(rows, "step string, done boolean, action string")


def overview(tables: Tables, now: Column, directories: int = 0, model: bool = False) -> dict[str, DataFrame | str | None]:
    """All of the page. ``jobs`` are states (jobs.fold); tables that a store does not have yet
    are left out but for the four of the cards."""
    counted = cards(tables)
    rows = counted.collect()  # four
    values = {r["key"]: (r["value"], r["detail"]) for r in rows}
    shown = counted.sparkSession.createDataFrame(rows, counted.schema)
    out: dict[str, DataFrame | str | None] = {"cards": shown, "capabilities": top_capabilities(tables["capabilities"]), "insights": insight_briefs(tables["insights"])}
    out["headline"], out["steps"] = steps(shown.sparkSession, values["projects"][0], values["assets"][0], values["projects"][1] is not None, directories, model)
    made = {"relations": ("graph", lambda _: graph_size(tables)), "opportunities": ("opportunities", opportunity_briefs), "activities": ("activities", lambda t: activity_briefs(t, now)), "jobs": ("job", job_brief)}
    return out | {name: make(tables[t]) for t, (name, make) in made.items() if t in tables}


# Breakdowns


def breakdown(rows: DataFrame, column: str, enum: str, zeros: bool = True) -> DataFrame:
    """value, n, share: counts by value in domain order with their share of all rows, zero
    where there are none. Values outside of the enumeration count as what they are read as;
    those that are read as nothing do not count."""
    read = rows.select(F.coalesce(enums.read_as(F.col(column), enum), F.lit(enums.UNKNOWN.get(enum))).alias(column))
    found = relational.facet(read, column, enums.lookup(rows.sparkSession, enum))
    total = read.agg(F.count(column).alias("_all"))
    shared = found.join(F.broadcast(total), F.lit(True)).select("value", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_all")), F.lit(0.0)).alias("share"), "ordinal")  # one row
    return (shared if zeros else shared.where("n > 0")).orderBy("ordinal").drop("ordinal")


def summary(insights: DataFrame, opportunities: DataFrame) -> DataFrame:
    """One row: insights, unread, opportunities, actionable, adoption_rate (null where no
    insight was judged useful or useless)."""
    useful, useless = (F.count_if(F.col("user_feedback") == v) for v in ("useful", "useless"))
    left = insights.agg(F.count("*").alias("insights"), F.count_if(F.col("user_feedback").isNull()).alias("unread"), F.try_divide(useful.cast("double"), useful + useless).alias("adoption_rate"))
    right = opportunities.agg(F.count("*").alias("opportunities"), F.count_if(F.col("status").isin(enums.ACTIONABLE)).alias("actionable"))
    return left.join(F.broadcast(right), F.lit(True)).select("insights", "unread", "opportunities", "actionable", "adoption_rate")  # one row
