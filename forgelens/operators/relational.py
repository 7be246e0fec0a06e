"""Filters, orders, pages, facets, look-ups and retention over any of the tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.scalars import any_of, contains_text, idle_days
from ..sources.tables import staged

#: Up to this many rows of words, a table of them is broadcast.
FEW_WORDS = 2_000_000
#: How many documents a task of a keyword join takes.
TASK_TEXTS = 4000


def keyword(df: DataFrame, text: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows with the trimmed keyword in any of the columns; a blank one filters nothing."""
    text = (text or "").strip()
    return df.where(any_of([F.coalesce(contains_text(F.col(c), text), F.lit(False)) for c in columns])) if text else df


def one_of(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """None: all rows. An empty list: no rows."""
    if values is None:
        return df
    return df.where(F.col(column).isin(list(values))) if values else df.where(F.lit(False))


def filter_projects(df: DataFrame, status: str | None = None, language: str | None = None, sensitive: bool | None = None, text: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("language", language), ("sensitive", sensitive)):
        df = df.where(F.col(column) == value) if value is not None else df
    return keyword(df.withColumn("_tags", F.array_join("tags", " ")), text, ["name", "description", "_tags"]).drop("_tags")


def has_evidence() -> Column:
    return (F.size("evidence.files") > 0) | (F.size("evidence.commits") > 0)


def filter_assets(df: DataFrame, project_id: str | None = None, types: Sequence[str] | None = None, text: str | None = None, min_score: float | None = None, tier: str | None = None, with_evidence: bool = False) -> DataFrame:
    floor = max([x for x in (min_score, {"high": 0.85, "medium": 0.70}.get(tier or "")) if x is not None], default=None)
    df = df.where(F.col("project_id") == project_id) if project_id is not None else df
    df = one_of(df, "type", types or None)
    df = df.where(F.col("reuse_score") >= checked_score(floor)) if floor is not None else df
    df = df.where(has_evidence()) if with_evidence else df
    return keyword(df.withColumn("_tags", F.array_join("tags", " ")), text, ["name", "description", "_tags", "source_path"]).drop("_tags")


def filter_insights(df: DataFrame, types: Sequence[str] | None = None, unread: bool | None = None, min_confidence: float | None = None) -> DataFrame:
    df = one_of(df, "type", types or None)
    if unread is not None:
        df = df.where(F.col("user_feedback").isNull() if unread else F.col("user_feedback").isNotNull())
    return df.where(F.col("confidence") >= checked_score(min_confidence)) if min_confidence is not None else df


def filter_opportunities(df: DataFrame, statuses: Sequence[str] | None = tuple(enums.ACTIONABLE), min_rating: int | None = None) -> DataFrame:
    df = one_of(df, "status", statuses)
    return df.where(F.col("rating") >= checked_rating(min_rating)) if min_rating is not None else df


def checked_score(x: float) -> float:
    if not 0 <= x <= 1:
        raise ValueError("a score is from 0 to 1")
    return x


def checked_rating(x: int) -> int:
    if not 1 <= x <= 5:
        raise ValueError("a rating is from 1 to 5")
    return x


def order(name: str) -> list[Column]:
    """The orders of the list pages; each ends with a unique column, so that pages never
    overlap. Layers are in the order of their names."""
    down, up = lambda c: F.col(c).desc(), F.col
    return {
        "project.recent": lambda: [F.coalesce("updated_at", F.lit("")).desc(), up("name"), up("id")],
        "project.health": lambda: [down("health_score"), up("name"), up("id")],
        "project.name": lambda: [F.lower("name"), up("id")],
        "project.size": lambda: [down("loc"), up("name"), up("id")],
        "asset.reuse": lambda: [down("reuse_score"), up("name"), up("id")],
        "asset.confidence": lambda: [down("confidence"), up("name"), up("id")],
        "asset.newest": lambda: [down("created_at"), up("name"), up("id")],
        "asset.name": lambda: [F.lower("name"), up("id")],
        "insight": lambda: [down("confidence"), down("created_at"), up("id")],
        "opportunity": lambda: [down("rating"), down("coverage"), down("created_at"), up("id")],
        "capability": lambda: [down("layer"), down("project_count"), up("name"), up("id")],
        "recent": lambda: [down("created_at"), down("seq")],
    }[name]()


#: Page sizes: default, most.
PAGES = {"project": (500, 1000), "asset": (500, 2000), "insight": (100, 500), "opportunity": (50, 200), "search": (20, 100), "activity": (20, 100), "audit": (100, 500)}


def page(df: DataFrame, kind: str, by: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    default, most = PAGES[kind]
    return df.orderBy(*by).offset(max(0, offset)).limit(min(max(limit or default, 1), most))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: Sequence[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows a key. With more keys than one row each this is a window with a rank
    limit, which Spark applies before the exchange, so a hot key sends n rows a task."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def keep_newest(df: DataFrame, order: list[Column], keep: int) -> DataFrame:
    return df.orderBy(*order).limit(keep)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, so map sides combine."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(df.columns)


def facet(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """value, n for all of ``values(value, ordinal)``, zeros included, in domain order."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "ordinal").orderBy("ordinal")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def tag_cloud(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def hydrate(ids: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """Entities in the order of ``ids(pos, id)``; ids without an entity are dropped."""
    return ids.join(entities, key).orderBy("pos")


def duplicate_names(assets: DataFrame, least: int = 2) -> DataFrame:
    """Names, whatever their case, that assets of several projects share."""
    return (
        assets.groupBy(F.lower("name").alias("name_key"))
        .agg(F.min("name").alias("name"), F.count_distinct("project_id").alias("projects"), F.round(F.avg("reuse_score"), 4).alias("avg_score"), F.count("*").alias("assets"))
        .where(F.col("projects") >= least)
    )


def adoption_rate(insights: DataFrame) -> DataFrame:
    """useful / (useful + useless); ignored and unread do not count; none: null."""
    useful, useless = (F.count_if(F.col("user_feedback") == v) for v in ("useful", "useless"))
    return insights.agg(F.try_divide(useful.cast("double"), useful + useless).alias("adoption_rate"))


def subtree(capabilities: DataFrame, root: str) -> DataFrame:
    """The ids below and at ``root``, however deep: one join a level, ended by the first that
    is empty. Levels are written tables, so no plan grows and nothing is kept in memory; an
    id that was met is not met again, so a loop among the rows ends, too."""
    below = capabilities.select(F.col("id").alias("_child"), F.col("parent_id").alias("id"))
    level = staged(capabilities.where(F.col("id") == root).select("id").distinct(), "level")
    out = level
    while not level.isEmpty():
        level = staged(level.join(below, "id").select(F.col("_child").alias("id")).distinct().join(out, "id", "left_anti"), "level")
        out = out.unionByName(level)
    return out


def project_counts(capabilities: DataFrame, relations: DataFrame) -> DataFrame:
    """Capabilities with project_count from implements edges; none: 0."""
    n = relations.where("relation_type = 'implements'").groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("_n"))
    return capabilities.join(n, "id", "left").withColumn("project_count", F.coalesce("_n", F.lit(0))).drop("_n")


def orphans(capabilities: DataFrame) -> DataFrame:
    """Leaves below the domains that no project implements."""
    parents = capabilities.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    return capabilities.where("layer <> 'domain' AND project_count = 0").join(parents, "id", "left_anti")


def tree(capabilities: DataFrame) -> DataFrame:
    """One row a domain with its capabilities and their implementations nested; capabilities
    whose domain is missing follow under a null domain."""
    leaves = capabilities.where("layer = 'implementation'").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "id", "confidence"))).alias("implementations"))
    middle = capabilities.where("layer = 'capability'").join(leaves, "id", "left")
    node = F.struct((-F.col("project_count")).alias("_order"), "name", "id", "confidence", "project_count", "implementations")
    grouped = middle.groupBy(F.col("parent_id").alias("domain_id")).agg(F.array_sort(F.collect_list(node)).alias("capabilities"))
    domains = capabilities.where("layer = 'domain'").select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    return domains.join(grouped, "domain_id", "full")


def tree_rows(capabilities: DataFrame) -> DataFrame:
    """The same tree as rows in its order, however large a domain is: domain_id, capability_id,
    id, layer, name, project_count, confidence. Domains and capabilities stand by count, then
    name, implementations by name; ids break ties. A row stands in the tree if its parents do,
    each one layer up; see tree_orphans for those that do not."""
    order = lambda p: [F.col("project_count").alias(f"_{p}_n"), F.col("name").alias(f"_{p}_name")]
    shown = ["id", "layer", "name", "project_count", "confidence"]
    layer = lambda name: capabilities.where(F.col("layer") == name)
    top = layer("domain").select(F.col("id").alias("domain_id"), *order("d"), *shown)
    keys = ["domain_id", "_d_n", "_d_name"]
    middle = layer("capability").withColumnRenamed("parent_id", "domain_id").join(top.select(keys), "domain_id").select(*keys, F.col("id").alias("capability_id"), *order("c"), *shown)
    keys += ["capability_id", "_c_n", "_c_name"]
    low = layer("implementation").withColumnRenamed("parent_id", "capability_id").join(middle.select(keys), "capability_id").select(*keys, *shown)
    rows = top.unionByName(middle, allowMissingColumns=True).unionByName(low, allowMissingColumns=True)
    by = [F.col("_d_n").desc(), F.col("_d_name"), F.col("domain_id"), F.col("_c_n").desc_nulls_first(), F.col("_c_name").asc_nulls_first(), F.col("capability_id").asc_nulls_first(), F.col("layer") == "implementation", F.col("name"), F.col("id")]
    return rows.orderBy(*by).select("domain_id", "capability_id", *shown)


def tree_orphans(capabilities: DataFrame) -> DataFrame:
    """Rows below the domains whose parent is missing or not named."""
    known = capabilities.select(F.col("id").alias("parent_id")).distinct()
    return capabilities.where("layer <> 'domain'").join(known, "parent_id", "left_anti").select(capabilities.columns)


def keyword_links(items: DataFrame, docs: DataFrame, item: str, doc: str, least: int = 3) -> DataFrame:
    """item, doc, shared: how many distinct keywords of an item's text the document's text
    contains, if ``least`` or more. Keywords are the runs of four or more letters, case
    aside; one counts inside of a longer word, too. Rows that share an id are one text.

    A keyword is all letters, so it lies within one run of letters and begins with one of that
    run's windows of four. Documents' runs are dealt once, by id, to as many tasks as their
    number asks for, so that what a task groups does not grow with the table; the keywords,
    where they are not too many for that, are broadcast, and no row moves again.
    """
    runs = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))
    few = lambda df: F.broadcast(df) if df.count() <= FEW_WORDS else df
    terms = items.select(item, F.explode(runs).alias("keyword")).distinct()
    begun = terms.select("keyword", F.substring("keyword", 1, 4).alias("head")).distinct()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TASK_TEXTS))
    words = docs.select(doc, runs.alias("runs")).repartition(tasks, doc).select(doc, F.explode("runs").alias("w"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - 3), lambda i: F.substring("w", i, F.lit(4))))
    pairs = words.select(doc, "w", F.explode(heads).alias("head")).join(few(begun), "head").where(F.contains("w", "keyword")).select(doc, "keyword").distinct()
    return pairs.join(few(terms), "keyword").groupBy(item, doc).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def touching(relations: DataFrame, entity: str) -> DataFrame:
    other = F.when(F.col("source_id") == entity, F.col("target_id")).otherwise(F.col("source_id"))
    return relations.where((F.col("source_id") == entity) | (F.col("target_id") == entity)).withColumn("other_id", other).orderBy(F.col("confidence").desc(), "id")


def similar_projects(relations: DataFrame, project: str, least: float = 0.5) -> DataFrame:
    return touching(relations.where((F.col("relation_type") == "similar_to") & (F.col("confidence") >= least)), project)


def language_shares(df: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """``df(*keys, name, loc)`` with whole percentages that sum to 100: floors, then one more
    for the largest remainders (ties by loc, then name)."""
    per = Window.partitionBy(*keys)
    exact = F.col("loc") * 100.0 / F.sum("loc").over(per)
    left = F.lit(100) - F.sum("_floor").over(per)
    rank = F.row_number().over(per.orderBy(F.col("_rest").desc(), F.col("loc").desc(), "name"))
    parts = df.where("loc > 0").withColumn("_exact", exact).withColumn("_floor", F.floor("_exact")).withColumn("_rest", F.round(F.col("_exact") - F.col("_floor"), 9))
    return parts.withColumn("pct", (F.col("_floor") + (rank <= left).cast("int")).cast("int")).drop("_exact", "_floor", "_rest")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out: Iterable[DataFrame] = (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items())
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def by_name(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Rows of just this name, whatever its case."""
    return df.where(F.lower(column) == name.lower())


def by_ids(df: DataFrame, ids: Sequence[str], key: str = "id") -> DataFrame:
    return one_of(df, key, ids)


def by_natural_key(capabilities: DataFrame, name: str, parent: str | None) -> DataFrame:
    """The capability of a name below a parent; null parent: a domain."""
    return capabilities.where((F.col("name") == name) & F.col("parent_id").eqNullSafe(F.lit(parent)))


def edges_of(relations: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    """Edges from a source, to a target, of a type; by confidence, then id."""
    for column, value in (("source_id", source), ("target_id", target), ("relation_type", kind)):
        relations = relations.where(F.col(column) == value) if value is not None else relations
    return relations.orderBy(F.col("confidence").desc(), "id")


def semi(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among the first column of ``wanted``."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias(key)), key, "left_semi")


def project_briefs(assets: DataFrame, projects: DataFrame, now: Column) -> DataFrame:
    """Assets with the name, language and idle days of their project, which may be gone."""
    idle = idle_days(F.col("last_commit_at").cast("timestamp"), F.col("updated_at").cast("timestamp"), now)
    brief = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), F.col("language").alias("project_language"), idle.alias("project_idle"))
    return assets.join(brief, "project_id", "left")


def totals(df: DataFrame, amount: str, at: str) -> DataFrame:
    """total, n, latest: one row, also of no rows."""
    return df.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("total"), F.count("*").alias("n"), F.max(at).alias("latest"))


def scan_state(projects: DataFrame, at: str = "scanned_at") -> DataFrame:
    """latest, scanned: blank times do not count."""
    known = F.nullif(F.trim(F.col(at)), F.lit(""))
    return projects.agg(F.max(known).alias("latest"), F.count(known).alias("scanned"))


def asset_counts(assets: DataFrame, since: Column | None = None, least: float = 0.70) -> DataFrame:
    """reusable, useful: assets of a good score, and those marked useful (since a time)."""
    marked = (F.col("user_feedback") == "useful") & (F.lit(True) if since is None else F.col("created_at") >= since)
    return assets.agg(F.count_if(F.col("reuse_score") >= least).alias("reusable"), F.count_if(marked).alias("useful"))


def insight_counts(insights: DataFrame) -> DataFrame:
    """total, unread, and the adoption rate."""
    counted = insights.agg(F.count("*").alias("total"), F.count_if(F.col("user_feedback").isNull()).alias("unread"))
    return counted.withColumn("_k", F.lit(1)).join(adoption_rate(insights).withColumn("_k", F.lit(1)), "_k").drop("_k")


def opportunity_counts(opportunities: DataFrame) -> DataFrame:
    """status, n, actionable, analysed: by status, with those that have an analysis."""
    has = F.nullif(F.trim("analysis_json"), F.lit("")).isNotNull()
    return opportunities.groupBy("status").agg(F.count("*").alias("n"), F.first(F.col("status").isin(enums.ACTIONABLE)).alias("actionable"), F.count_if(has).alias("analysed"))


def exists_where(df: DataFrame, condition: Column) -> DataFrame:
    """One row: whether any row meets the condition."""
    return df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("exists"))


def kind_counts(hits: DataFrame) -> DataFrame:
    """kind, n over a page of hits, all kinds, zeros included."""
    return facet(hits, "kind", enums.lookup(hits.sparkSession, "hit_kind")).select(F.col("value").alias("kind"), "n", "ordinal")


def append(log: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """An append-only log (activities, audit) with new rows: each takes the next ``seq``, in
    the order of their columns, by which rows of one time keep their order, and the time
    ``at``. The new rows are sorted by ranges and written; a row's number is its place in its
    range, after the ranges before it, of which one row each is counted."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_rows = rows.repartitionByRange(*rows.columns).sortWithinPartitions(*rows.columns).withColumns({"_part": part, "_place": place})
    written = staged(sorted_rows, "rows")
    before = written.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = written.join(F.broadcast(before), "_part").withColumn("seq", F.col("_before") + F.col("_place") + 1 + last)
    return log.unionByName(numbered.withColumn("created_at", at).select(log.columns))


def recent(log: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """The newest rows of a log; rows of one time by ``seq``."""
    return page(log, kind, order("recent"), limit)
