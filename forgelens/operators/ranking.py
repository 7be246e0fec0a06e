"""Hybrid search: blended ranking over the recalled rows of every kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, collapse_spaces, idle_days, let, percent, stars
from . import retrieval

RELEVANCE, QUALITY, RECENCY, BOOST = 0.55, 0.25, 0.20, 0.25
FRESH_DAYS = 30
RECALL, BROWSE = 60, 200
SCOPES = {
    "all": ["project", "asset", "capability", "insight", "opportunity"], "projects": ["project"], "assets": ["asset"],
    "capabilities": ["capability"], "insights": ["insight"], "opportunities": ["opportunity"],
}


def blend(relevance: Column, quality: Column, recency: Column) -> Column:
    return clamp(RELEVANCE * relevance + QUALITY * quality + RECENCY * recency, 0.0, 1.0)


def recency(days: Column) -> Column:
    """1 today, 0 from a month on, between them linear; unknown 0."""
    return F.coalesce(clamp(1 - days / F.lit(float(FRESH_DAYS)), 0.0, 1.0), F.lit(0.0))


def size_bonus(loc: Column) -> Column:
    return F.least(F.coalesce(F.log10(F.greatest(loc, F.lit(1))) / 4, F.lit(0.0)), F.lit(1.0))


QUALITY_OF = {
    "project": lambda: 0.85 * F.col("health_score") / 100.0 + 0.15 * size_bonus(F.col("loc")),
    "asset": lambda: F.col("reuse_score"),
    "capability": lambda: F.least(F.col("project_count"), F.lit(5)) / 5.0,
    "insight": lambda: F.col("confidence"),
    "opportunity": lambda: 0.7 * (F.col("rating") - 1) / 4.0 + 0.3 * F.col("coverage"),
}


def boosted(score: Column, title: Column, terms: Sequence[str]) -> Column:
    """A quarter more if any term stands in the title, whatever its case."""
    if not terms:
        return score
    hit = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(title), t))
    return clamp(score + F.when(hit, F.lit(BOOST)).otherwise(F.lit(0.0)), 0.0, 1.0)


def reasons(relevance: Column, quality: Column, fresh: Column) -> Column:
    """The factors that count, the weightiest first."""
    parts = F.array(F.struct((-RELEVANCE * relevance).alias("w"), F.lit("relevance").alias("r")), F.struct((-QUALITY * quality).alias("w"), F.lit("quality").alias("r")), F.struct((-RECENCY * fresh).alias("w"), F.lit("recency").alias("r")))
    return F.transform(F.filter(F.array_sort(parts), lambda p: p["w"] < 0), lambda p: p["r"])


def _hit(df: DataFrame, kind: str, days: Column | None, title: str, subtitle: Column, terms: Sequence[str], keys: dict[str, Column]) -> DataFrame:
    fresh = recency(days) if days is not None else F.lit(0.0)
    quality = QUALITY_OF[kind]()
    return df.select(
        F.lit(kind).alias("kind"), "id", F.col(title).alias("title"), subtitle.alias("subtitle"),
        boosted(blend(F.col("relevance"), quality, fresh), F.col(title), terms).alias("score"), reasons(F.col("relevance"), quality, fresh).alias("reasons"),
        F.when(F.col("from_substring"), F.lit("substring")).otherwise(F.lit("full_text")).alias("source"), F.col("relevance"),
        *[keys.get(k, F.lit(None)).cast("double").alias(f"key_{k}") for k in ("quality", "recency", "name_order")],
    )


def search(tables: dict[str, DataFrame], text: str, now: Column, scope: str = "all", sort: str = "relevance", limit: int = 20, offset: int = 0, recall_limit: int = RECALL, status: str | None = None, language: str | None = None, project_id: str | None = None, types: Sequence[str] | None = None, min_score: float | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of hits, one row with their total). Blank text browses.

    Each kind is recalled up to ``recall_limit``, then filtered, scored and united; filters
    act on what was recalled, so the total counts what is left of it. Project and asset
    filters leave the other kinds alone. Tables need the columns of INDEXED as text.
    """
    if len(text) > 200:
        raise ValueError("a query has at most 200 characters")
    terms, blank = text.split(), not text.strip()
    found = []
    for kind in SCOPES[scope]:
        df = tables.get(kind)
        if df is None:
            continue
        if blank:
            df = df.where("evidence_count > 0") if kind == "asset" else df.where("status IN ('new', 'explored')") if kind == "opportunity" else df
            df = df.withColumns({"relevance": F.lit(0.0), "from_substring": F.lit(False)}).withColumn("_q", QUALITY_OF[kind]()).orderBy(F.col("_q").desc(), "id").limit(BROWSE).drop("_q")
        else:
            df = retrieval.recall(df, kind, text, recall_limit, index)
        if kind == "project":
            df = df.where(F.col("status") == status) if status else df
            df = df.where(F.lower("language") == language.lower()) if language else df
            days = idle_days(F.col("last_commit_at").cast("timestamp"), F.col("updated_at").cast("timestamp"), now)
            found.append(_hit(df, kind, days, "name", F.concat_ws(" · ", "language", "framework"), terms, {"quality": F.col("health_score") / 100.0, "recency": recency(days)}))
        elif kind == "asset":
            df = df.where(F.col("type").isin(list(types))) if types else df
            df = df.where(F.col("project_id") == project_id) if project_id else df
            df = df.where(F.col("reuse_score") >= min_score) if min_score is not None else df
            df = df.where(F.exists(F.split("tags", " "), lambda t: F.lower(t) == language.lower())) if language else df
            found.append(_hit(df, kind, None, "name", F.concat_ws(" · ", "type", "source_path"), terms, {"quality": F.col("reuse_score"), "recency": F.lit(0.5)}))
        elif kind == "capability":
            found.append(_hit(df, kind, None, "name", F.format_string("%d projects", "project_count"), terms, {"quality": QUALITY_OF[kind](), "recency": F.lit(0.5)}))
        elif kind == "insight":
            found.append(_hit(df, kind, None, "title", F.col("type"), terms, {"quality": F.col("confidence"), "recency": F.lit(0.5)}))
        else:
            found.append(_hit(df, kind, None, "title", stars(F.col("rating")), terms, {"quality": QUALITY_OF[kind](), "recency": F.lit(0.5)}))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits.orderBy(*hit_order(sort)).offset(offset).limit(min(max(limit, 1), 100)), hits.agg(F.count("*").alias("total"))


def hit_order(sort: str) -> list[Column]:
    """Score, then id; an explicit key where one is asked, and score where it is missing."""
    primary = {"relevance": F.col("score"), "quality": F.coalesce("key_quality", "score"), "recent": F.coalesce("key_recency", "score")}
    if sort == "name":
        return [F.lower("title"), F.col("score").desc(), F.col("id")]
    return [F.nanvl(primary[sort], F.lit(0.0)).desc(), F.col("score").desc(), F.col("id"), F.col("kind")]


def per_kind(hits: DataFrame, n: int) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "id"))).where(F.col("_n") <= n).drop("_n")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def snippet(text: Column, terms: Sequence[str], around: int = 12, head: int = 48) -> Column:
    """The earliest term with ``around`` characters on either side, marked; else the first
    ``head`` characters. Every part is escaped; places are characters of the text itself."""
    low = [F.lit(t.lower()) for t in terms]

    def shown(flat: Column) -> Column:
        plain = escape_html(F.when(F.length(flat) > head, F.concat(F.substring(flat, 1, head), F.lit("…"))).otherwise(flat))
        places = let(F.lower(flat), lambda lowered: F.array(*[F.struct(F.nullif(F.position(t, lowered), F.lit(0)).alias("at"), F.lit(len(term)).alias("n")) for t, term in zip(low, terms, strict=True)]))
        first = F.array_min(F.filter(places, lambda p: p["at"].isNotNull())) if terms else None
        return plain if first is None else let(first, lambda hit: F.when(hit.isNull(), plain).otherwise(marked(flat, hit["at"], hit["n"])))

    def marked(flat: Column, at: Column, n: Column) -> Column:
        begin = F.greatest(at - around, F.lit(1))
        before, after = F.substring(flat, begin, at - begin), F.substring(flat, at + n, F.lit(around))
        return F.concat(
            F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), escape_html(before), F.lit("<mark>"), escape_html(F.substring(flat, at, n)), F.lit("</mark>"),
            escape_html(after), F.when(F.length(flat) > at + n + around - 1, F.lit("…")).otherwise(F.lit("")),
        )

    return let(collapse_spaces(text), shown)


def strip_marks(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<mark>"), F.lit("")), F.lit("</mark>"), F.lit(""))


LABELS = {"project": "Project", "asset": "Asset", "capability": "Capability", "insight": "Insight", "opportunity": "Opportunity"}


def api_view(hits: DataFrame) -> DataFrame:
    """Hits as a client shows them: score in percent, the kind's label, the page's link."""
    label = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in LABELS.items()], F.col("kind"))
    return hits.select("kind", "id", "title", percent(F.col("score")).alias("percent"), label.alias("label"), F.concat(F.lit("/"), F.col("kind"), F.lit("/"), F.col("id")).alias("link"))
