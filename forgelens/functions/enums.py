"""Enumerations: their values in domain order, and what unknown values become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The contract of the stored data, in domain order.
VALUES = {
    "project_status": ["active", "paused", "abandoned", "experimental", "unknown"],
    "asset_type": ["code", "component", "api", "prompt", "knowledge", "decision", "experience", "idea", "outcome", "ai_artifact"],
    "reuse_tier": ["high", "medium", "low"],
    "capability_layer": ["domain", "capability", "implementation"],
    "entity_kind": ["project", "asset", "capability", "knowledge", "experience", "idea", "technology", "problem"],
    "relation_type": [
        "contains", "implements", "uses", "produces", "generates", "resulted_in", "similar_to", "reused_by", "depends_on",
        "combines_with", "derived_from", "supports", "related_to", "happened_in", "solves", "informs", "can_combine_with",
    ],
    "insight_type": ["duplicate_capability", "reusable_component", "reusable_experience", "forgotten_asset", "tech_direction", "opportunity_hint"],
    "insight_badge": ["high", "potent", "info"],
    "opportunity_status": ["new", "explored", "dismissed", "adopted"],
    "job_type": [
        "SCAN_PROJECT", "INDEX_CODE", "PARSE_AST", "BUILD_SYMBOL_GRAPH", "GENERATE_EMBEDDING", "ANALYZE_PROJECT", "EXTRACT_ASSETS",
        "EXTRACT_CAPABILITIES", "ANALYZE_RELATIONS", "GENERATE_INSIGHT", "DISCOVER_OPPORTUNITY",
    ],
    "job_status": ["queued", "running", "completed", "failed", "cancelled"],
    "user_feedback": ["useful", "useless", "ignored"],
    "symbol_kind": ["function", "method", "class", "struct", "enum", "trait", "interface", "constant", "component", "api_endpoint", "type"],
    "hit_kind": ["project", "asset", "capability", "knowledge", "experience", "idea", "technology", "insight", "opportunity"],
    "activity_icon": ["repeat", "check", "link", "bulb", "scan", "alert"],
}
#: What a value outside of the enumeration becomes when a row is read.
UNKNOWN = {
    "project_status": "unknown", "asset_type": "code", "capability_layer": "capability", "relation_type": "related_to",
    "insight_type": "reusable_component", "opportunity_status": "new", "job_type": "INDEX_CODE", "job_status": "queued", "user_feedback": None, "activity_icon": "check",
}
#: Job types that call a model.
NEED_MODEL = ["ANALYZE_PROJECT", "EXTRACT_CAPABILITIES", "ANALYZE_RELATIONS", "GENERATE_INSIGHT", "DISCOVER_OPPORTUNITY"]
DEEP = ["ANALYZE_RELATIONS", "GENERATE_INSIGHT", "DISCOVER_OPPORTUNITY"]
TERMINAL = ["completed", "failed", "cancelled"]
ACTIONABLE = ["new", "explored"]
FEEDBACK = ["useful", "useless", "ignored"]
SYMMETRIC = ["similar_to", "combines_with", "can_combine_with", "related_to"]


def lookup(spark: SparkSession, enum: str) -> DataFrame:
    """value, ordinal: one row a value, in domain order. No Python worker runs for it."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in VALUES[enum]])).alias("ordinal", "value"))


def read_as(c: Column, enum: str) -> Column:
    """The value, or what an unknown one becomes."""
    return F.when(c.isin(VALUES[enum]), c).otherwise(F.lit(UNKNOWN.get(enum)))


def reuse_tier(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("low")


def insight_badge(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.70, "potent").otherwise("info")


#: Kinds of hits that are cited as what they are; all others are cited as files.
CITED = ["project", "asset", "capability", "insight", "opportunity"]


def citation_kind(hit_kind: Column) -> Column:
    return F.when(hit_kind.isin(CITED), hit_kind).otherwise(F.lit("file"))


def job_class(job_type: Column) -> Column:
    """A struct: needs_model, deep."""
    return F.struct(job_type.isin(NEED_MODEL).alias("needs_model"), job_type.isin(DEEP).alias("deep"))
