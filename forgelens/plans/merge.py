"""Writes: merges by column owner, deletes and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import ACTIONABLE

#: Who owns which columns: a merge takes them from the new rows, all others stay.
OWNERS: dict[str, dict[str, list[str]]] = {
    "projects": {
        "scan": ["name", "path", "language", "framework", "updated_at", "last_commit_at", "status", "health_score", "completeness", "file_count", "loc", "languages", "tags", "git_commits", "has_git", "has_readme", "has_tests", "scanned_at"],
        "index": ["symbol_count", "module_count"], "model": ["ai_profile"], "user": ["sensitive", "description"],
    },
    "assets": {"index": ["type", "name", "description", "content", "source_path", "confidence", "reuse_score", "generality", "stability", "tags", "evidence"], "user": ["user_feedback"]},
    "insights": {"detector": ["type", "title", "description", "evidence", "confidence", "tags", "project_ids", "asset_ids"], "user": ["user_feedback"]},
    "opportunities": {"engine": ["title", "description", "source_project_ids", "source_asset_ids", "required_capabilities", "missing_capabilities", "coverage", "rating", "why", "evidence"], "user": ["status"], "model": ["analysis_json"]},
}


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], owned: Sequence[str]) -> DataFrame:
    """Old and new rows by key: of rows in both, ``owned`` columns are the new ones, all
    others stay; rows of either side alone stay as they are. Keys may be null."""
    o, n = old.withColumn("_in", F.lit(True)).alias("o"), new.withColumn("_in", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    met = o.join(n, on, "full")
    both, added = F.col("o._in") & F.col("n._in"), F.col("o._in").isNull()

    def pick(c: str) -> Column:
        left = F.col(f"o.{c}") if c in old.columns else F.lit(None)
        right = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            return F.when(added, right).otherwise(left).alias(c)
        return F.when(added | (both & F.lit(c in owned and c in new.columns)), right).otherwise(left).alias(c)

    return met.select(*[pick(c) for c in dict.fromkeys([*old.columns, *new.columns])])


def last_wins(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*").select(rows.columns)


def gate(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, one row with both counts): rejected rows are counted, never lost silently."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def valid_capability() -> Column:
    rooted = (F.col("layer") == "domain") == F.col("parent_id").isNull()
    return (F.trim("name") != "") & F.col("confidence").between(0, 1) & rooted


def known_ids(new: DataFrame, old: DataFrame) -> DataFrame:
    """New capabilities with the id that their (name, parent) already has."""
    o = old.select(F.col("name").alias("_n"), F.col("parent_id").alias("_p"), F.col("id").alias("_id"))
    met = new.join(o, (F.col("name") == F.col("_n")) & F.col("parent_id").eqNullSafe(F.col("_p")), "left")
    return met.withColumn("id", F.coalesce("_id", "id")).drop("_n", "_p", "_id")


def delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def dismiss_all(opportunities: DataFrame) -> DataFrame:
    return opportunities.withColumn("status", F.when(F.col("status").isin(ACTIONABLE), "dismissed").otherwise(F.col("status")))


def set_status(opportunities: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(id, status)``; adopted ones stay adopted."""
    met = opportunities.join(wanted.select("id", F.col("status").alias("_new")), "id", "left")
    return met.withColumn("status", F.when(F.col("status") == "adopted", F.col("status")).otherwise(F.coalesce("_new", "status"))).select(opportunities.columns)


def set_analysis(opportunities: DataFrame, analyses: DataFrame) -> DataFrame:
    """``analyses(id, analysis_json)``; new opportunities become explored."""
    met = opportunities.drop("analysis_json").join(analyses.select("id", "analysis_json"), "id", "left")
    return met.withColumn("status", F.when((F.col("status") == "new") & F.col("analysis_json").isNotNull(), "explored").otherwise(F.col("status")))


def clear_derived(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Without what scans and detectors made; user marks, descriptions, settings and the
    audit log stay."""
    out = {name: df.limit(0) if name in ("assets", "capabilities", "relations", "jobs", "insights", "opportunities", "activities") else df for name, df in tables.items()}
    if "projects" in out:
        projects = out["projects"]
        derived = [c for c in ("symbol_count", "module_count", "ai_profile") if c in projects.columns]
        out["projects"] = projects.withColumns({c: F.lit(None).cast(dict(projects.dtypes)[c]) for c in derived})
    return out


def clear_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    out = dict(tables)
    for name, key in (("assets", "project_id"), ("projects", "id")):
        if name in out:
            out[name] = out[name].where(F.col(key) != project)
    if "relations" in out:
        out["relations"] = out["relations"].where((F.col("source_id") != project) & (F.col("target_id") != project))
    return out
