"""Scores: reuse of symbols, health and status of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import any_of, clamp, count_in, stable_id

#: Weights of the five factors, least score and least body of a tracked symbol.
WEIGHTS = {"size": 0.25, "generality": 0.30, "documentation": 0.15, "referenced": 0.20, "kind": 0.10}
THRESHOLD, LEAST_BODY = 0.42, 3
KIND = {"component": 1.0, "trait": 1.0, "interface": 1.0, "class": 0.9, "struct": 0.9, "enum": 0.9, "api_endpoint": 0.7, "method": 0.8, "function": 0.8, "constant": 0.35, "type": 0.35}
ASSET_TYPE = {"component": "component", "api_endpoint": "api"}


def disposable(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike("20[0-9]{2}") | any_of([low.startswith(p) for p in rules.DISPOSABLE_PREFIXES]) | any_of([F.contains(low, F.lit(p)) for p in rules.DISPOSABLE_PARTS])


def size_score(lines: Column) -> Column:
    return F.when(lines <= 0, 0.0).when(lines <= 2, 0.25).when(lines <= 7, 0.6).when(lines <= 120, 1.0).when(lines <= 300, 0.85).otherwise(0.6)


def kind_score(kind: Column) -> Column:
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for p in KIND.items() for x in p]), lambda k, v: k == kind)), F.lit(0)), F.lit(0.35))


def generality(name: Column, signature: Column, parent: Column, project: Column | None = None) -> Column:
    low, sig = F.lower(name), F.lower(signature)
    score = F.lit(0.5)
    if project is not None:
        norm = F.regexp_replace(F.lower(project), r"[-_ ]", "")
        score = score - F.when((F.length(norm) >= 4) & F.contains(low, norm), 0.3).otherwise(0.0)
    score = score - 0.18 * F.least(count_in(low, rules.BUSINESS), F.lit(2)) + 0.12 * F.least(count_in(low, rules.GENERIC), F.lit(3))
    score = score - F.when(any_of([F.contains(sig, F.lit(p)) for p in ("c:/", "d:/", "/users/")]), 0.2).otherwise(0.0)
    typed = F.contains(signature, F.lit("-> ")) | (F.contains(signature, F.lit(": ")) & F.contains(signature, F.lit("(")))
    score = score + F.when(typed, 0.1).otherwise(0.0)
    score = score - F.when((F.length(name) <= 2) & parent.isNull(), 0.2).otherwise(0.0)
    score = score + F.when(F.contains(signature, F.lit("pub ")) | F.contains(signature, F.lit("export ")), 0.1).otherwise(0.0)
    return clamp(score, 0.0, 1.0)


def score_symbols(symbols: DataFrame, project: str | None = None) -> DataFrame:
    """``symbols`` with reuse_score, generality, stability, confidence, worth_tracking.
    ``project`` names a column with the project's name."""
    doc = F.coalesce(F.trim("doc_comment") != "", F.lit(False))
    sized, general = size_score(F.col("body_lines")), generality(F.col("name"), F.col("signature"), F.col("parent"), F.col(project) if project else None)
    doc_factor, ref_factor = F.when(doc, 1.0).otherwise(0.25), F.when(F.col("referenced_locally"), 1.0).otherwise(0.35)
    raw = WEIGHTS["size"] * sized + WEIGHTS["generality"] * general + WEIGHTS["documentation"] * doc_factor + WEIGHTS["referenced"] * ref_factor + WEIGHTS["kind"] * kind_score(F.col("kind"))
    raw = clamp(raw / sum(WEIGHTS.values()), 0.0, 1.0)
    stable = clamp(0.5 + (doc_factor - 0.25) * 0.3 + (sized - 0.5) * 0.25 + F.when(F.col("name").rlike("^[A-Za-z_]"), 0.1).otherwise(0.0) + F.when(F.col("parent").isNotNull(), 0.1).otherwise(0.0), 0.0, 1.0)
    sure = F.least(F.lit(0.6) + F.when(doc, 0.15).otherwise(0.0) + F.when(F.col("body_lines") > 0, 0.1).otherwise(0.0) + F.when(F.col("signature") != "", 0.07).otherwise(0.0), F.lit(0.92))
    dead = disposable(F.col("name"))
    pick = lambda c, if_dead: F.when(dead, F.lit(if_dead)).otherwise(F.round(c, 2))
    worth = ~dead & (raw >= THRESHOLD) & ~F.col("kind").isin("constant", "type") & (F.col("body_lines") >= LEAST_BODY)
    return symbols.withColumns({"reuse_score": pick(raw, 0.0), "generality": pick(general, 0.0), "stability": pick(stable, 0.0), "confidence": pick(sure, 0.9), "worth_tracking": worth})


def to_assets(scored: DataFrame, created_at: Column) -> DataFrame:
    """Tracked symbols as asset rows; each has its file as evidence."""
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in ASSET_TYPE.items()], F.lit("code"))
    return scored.where("worth_tracking").select(
        stable_id("a", F.col("name"), F.col("project_id"), F.col("file_path"), F.col("name"), F.col("line")).alias("id"),
        "project_id", kind.alias("type"), "name", F.coalesce(F.nullif(F.trim("doc_comment"), F.lit("")), F.col("signature")).alias("description"), F.col("signature").alias("content"),
        F.col("file_path").alias("source_path"), "confidence", "reuse_score", "generality", "stability", F.array_distinct(F.array(F.lower("language"), F.col("kind"))).alias("tags"),
        F.struct(F.array("file_path").alias("files"), F.array().cast("array<string>").alias("commits"), F.array().cast("array<string>").alias("used_by"), F.array().cast("array<string>").alias("reasoning")).alias("evidence"),
        created_at.alias("created_at"), F.lit(None).cast("string").alias("user_feedback"),
    )


def health(commits: Column, git: Column, readme: Column, tests: Column, loc: Column, idle: Column) -> Column:
    """0..100: half activity, three tenths completeness, two tenths scale."""
    activity = F.when(idle.isNull(), 0.3).when(idle <= 30, 1.0).when(idle <= 90, 0.8).when(idle <= 180, 0.6).when(idle <= 365, 0.4).otherwise(0.2)
    complete = F.when(git, 0.5).otherwise(0.0) + F.when(readme, 0.3).otherwise(0.0) + F.when(tests, 0.2).otherwise(0.0)
    complete = F.when(commits > 50, F.least(complete + 0.1, F.lit(1.0))).otherwise(complete)
    scale = F.when(loc <= 0, 0.0).when(loc <= 50, 0.3).when(loc <= 2000, 0.8).when(loc <= 200_000, 1.0).otherwise(0.7)
    return F.round((activity * 0.5 + complete * 0.3 + scale * 0.2) * 100).cast("int")


def status(commits: Column, idle: Column, loc: Column) -> Column:
    return F.when(((commits > 0) & (commits <= 3)) | (loc < 30), "experimental").when(idle.isNull() | (idle <= 90), "active").when(idle <= 365, "paused").otherwise("abandoned")
