"""The tables of a store, and the steps that bring older stores to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import postings
from ..sources.tables import Step, Store, Tables, migrate
from .jobs import EVENTS

EVIDENCE = "struct<files:array<string>,commits:array<string>,functions:array<string>>"
#: The tables of the first version.
FIRST: dict[str, str] = {
    "projects": "id string, name string, path string, language string, status string, sensitive boolean, description string, ai_profile string, updated_at string",
    "assets": f"id string, project_id string, type string, name string, description string, content string, source_path string, confidence double, reuse_score double, tags array<string>, evidence {EVIDENCE}, user_feedback string",
    "capabilities": "id string, name string, layer string, parent_id string, confidence double, project_count long",
    "relations": "id string, source_id string, source_type string, relation_type string, target_id string, target_type string, confidence double, evidence array<string>",
    "insights": "id string, title string, description string, tags_json string, type string, evidence_json string, confidence double, user_feedback string, created_at string",
    "opportunities": "id string, title string, description string, why string, required_capabilities_json string, missing_capabilities_json string, evidence_json string, status string, rating int",
    "jobs": EVENTS, "activities": "seq long, icon string, kind string, text string, created_at timestamp",
    "audit_log": "seq long, model string, project_id string, summary string, created_at timestamp",
    "settings": "key string, value string, sensitive boolean, seq long",
}


def first_version(spark: SparkSession, tables: Tables) -> Tables:
    """All tables, empty; what is there stays."""
    return {name: spark.createDataFrame([], schema) for name, schema in FIRST.items() if name not in tables}


def _listed(column: str, field: str | None = None):
    """The elements of a JSON array, or one field of each, joined by spaces: quotes and
    brackets are no text to search in. What is no array: null."""
    items = F.from_json(F.col(column), "array<string>" if field is None else f"array<struct<{field}:string>>")
    return F.array_join(items if field is None else F.transform(items, lambda x: x[field]), " ")


def searched_insights(insights: DataFrame) -> DataFrame:
    """The text columns of insights that are searched; of the evidence, labels alone."""
    return insights.select("id", "title", "description", _listed("tags_json").alias("tags"), "type", _listed("evidence_json", "label").alias("evidence"))


def searched_opportunities(opportunities: DataFrame) -> DataFrame:
    both = F.concat_ws(" ", _listed("required_capabilities_json"), _listed("missing_capabilities_json"))
    return opportunities.select("id", "title", "description", "why", both.alias("capabilities"), _listed("evidence_json").alias("evidence"))


SEARCHED = {"insights": (searched_insights, ["title", "description", "tags", "type", "evidence"]), "opportunities": (searched_opportunities, ["title", "description", "why", "capabilities", "evidence"])}


def searchable(spark: SparkSession, tables: Tables) -> Tables:
    """Postings of insights and opportunities, of all rows that are there."""
    return {f"{name}_postings": postings.postings(text(tables[name]), columns, "id") for name, (text, columns) in SEARCHED.items()}


def audited(spark: SparkSession, tables: Tables) -> Tables:
    """Audit rows with ok and error. Before this version only calls that succeeded were
    written, so calls of a model (which is not '-') are ok; other events were no calls: null."""
    log = tables["audit_log"]
    return {"audit_log": log.withColumns({"ok": F.when(S.non_empty(F.col("model")).isNotNull() & (F.col("model") != "-"), True), "error": F.lit(None).cast("string")})}


STEPS: list[Step] = [first_version, searchable, audited]


def upgrade(store: Store) -> dict:
    """from, to, applied."""
    return migrate(store, STEPS)
