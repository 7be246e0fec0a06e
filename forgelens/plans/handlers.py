"""The stages of the job chain: scan, index, insight, over tables in one folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import normalize_path, stable_id
from ..operators import capabilities, insights, relational, scoring
from ..sources import history, manifests, projects, symbols, tables, trees
from . import merge
from .settings import ScanSettings

#: At most this many projects of a scan are kept, by path; a parameter of ``scan``.
MOST_PROJECTS = 2000
SCANNED = ["name", "path", "kind", "language", "has_git", "has_readme", "has_tests", "has_license", "has_docker", "loc", "git_commits", "last_commit_at", "updated_at", "health_score", "status", "branch", "recent_commits", "contributors", "recent_subjects"]
INDEXED = ["type", "name", "description", "content", "source_path", "confidence", "reuse_score", "generality", "stability", "tags", "evidence"]
DETECTED = ["type", "title", "confidence", "project_ids", "asset_ids", "evidence", "tags", "badge"]


class Store(tables.Store):
    """The tables of the chain; each stage's changes are versions of their own."""

    def merge(self, name: str, rows: DataFrame, owned: Sequence[str]) -> DataFrame:
        """New rows by id; of known ones the columns that the stage owns change. The version
        that was merged is the one that is replaced, or Conflict."""
        at = self.version()
        return self.replace(name, merge.merge(self.read(name, at), rows, ["id"], owned) if self.has(name) else rows, at)


def targets(asked: Sequence[str], settings: Sequence[str] = ()) -> list[str]:
    """The folders to scan: those asked for, else those of the settings; trimmed, once each,
    in order. None at all is an error."""
    found = list(dict.fromkeys(p.strip() for p in asked if p.strip())) or list(dict.fromkeys(p.strip() for p in settings if p.strip()))
    if not found:
        raise ValueError("no folder to scan")
    return found


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The files below a root as trees.SCHEMA, as a table in the shared folder: the tree is
    walked once, and what is used of it later is all of one moment."""
    if trees.is_local(root):
        return tables.staged(trees.listing(spark, root), "files")
    return projects.listing(spark, root).withColumn("error", F.lit(None).cast("string"))


def owned_files(files: DataFrame) -> DataFrame:
    """Files of the projects among ``listed`` ones, each with its project's folder and what it
    shows."""
    good = files.where("error IS NULL")
    return projects.assign(good, projects.project_roots(good, files.sparkSession))


def scanned(files: DataFrame, parsed: DataFrame, now: Column, log: DataFrame | None = None, root: str = "") -> DataFrame:
    """Project rows of ``owned_files``: languages, age, marks, health and status. ``log``:
    commits of history.read_log, by the folder's whole path."""
    spark = files.sparkSession
    marks = files.groupBy("dir").agg(*[F.first(c).alias(c) for c in ("kind", "has_git", "has_readme", "has_tests", "has_license", "has_docker")])
    stats = projects.language_stats(files)
    loc = stats.groupBy(F.col("project_id").alias("dir")).agg(F.sum("loc").alias("loc"))
    main = projects.primary_language(stats).withColumnRenamed("project_id", "dir")
    age = projects.newest(files).withColumnRenamed("project_id", "dir")
    heads = files.where("endswith(rel_path, '.git/HEAD')").groupBy("dir").agg(F.min(projects.branch(F.try_validate_utf8("content"))).alias("branch"))
    met = marks.join(loc, "dir", "left").join(main, "dir", "left").join(age, "dir", "left").join(heads, "dir", "left")
    if log is None:
        met = met.withColumns({"commits": F.lit(None).cast("long"), "last_commit": F.lit(None).cast("timestamp"), "recent": F.lit(None).cast("long"), "authors": F.lit(None).cast("long"), "subjects": F.array().cast("array<string>")})
    else:
        whole = normalize_path(F.concat_ws("/", F.lit(root.removeprefix("file://").rstrip("/")), F.nullif("dir", F.lit(""))))
        known = history.history(log, now).select(F.col("project_id").alias("whole"), "commits", "last_commit", "recent", "authors", "subjects")
        met = met.withColumn("whole", whole).join(known, "whole", "left").drop("whole")
    rows = projects.to_projects(met, now)
    tags = manifests.frameworks(parsed.where("error IS NULL"), spark).select(F.col("project_id").alias("path"), F.col("frameworks").alias("tags"))
    facts = met.select(F.col("dir").alias("path"), "branch", F.col("recent").alias("recent_commits"), F.col("authors").alias("contributors"), F.coalesce("subjects", F.array().cast("array<string>")).alias("recent_subjects"))
    return rows.join(tags, "path", "left").join(facts, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


PROBLEMS = "root string, path string, stage string, error string"


def scan(store: Store, roots: Sequence[str], now: Column, most: int = MOST_PROJECTS, report: Callable = lambda p: None, log: str | None = None, strict: bool = False) -> DataFrame:
    """Scans each root and merges its projects into the table; user marks and descriptions
    stay. ``log``: exported commit logs (see history). Returns the
    problems (PROBLEMS), which are the table ``problems`` until the next scan:

    - ``root``: a root that cannot be read; it does not stop the others, but all of them
      failing is an error.
    - ``read``: a file or folder that cannot be read. Its project is not merged: half of a
      project is no project. Other projects are.
    - ``manifest``: one that is broken. Its project has no dependencies of it; with
      ``strict`` it is not merged.
    - ``cut``: a project beyond the first ``most`` of its root by path, which is not merged.
    - ``log``: a line of the commit logs that is no commit.
    """
    spark = store.spark
    problems, broken, done = [], [], 0
    roots = targets(roots)
    commits = None
    if log:
        commits, rejected = history.read_log(spark, log)
        commits = tables.staged(commits, "commits")
        problems.append(rejected.select(F.lit(log).alias("root"), F.col("file").alias("path"), F.lit("log").alias("stage"), "error"))
    for k, root in enumerate(roots):
        try:
            files = listed(spark, root)
            errors = files.where("error IS NOT NULL")
            owned = owned_files(files)
            parsed = tables.staged(manifests.parsed(owned.select(F.col("dir").alias("project_id"), "name", "content")), "parsed")
            bad = parsed.where("error IS NOT NULL").select(F.col("project_id").alias("dir"), "error")
            rows = scanned(owned, parsed, now, commits, root)
            unread = trees.failed_projects(errors, rows.select(F.col("path").alias("dir")))
            gone = unread.select(F.col("dir").alias("path")).unionByName(bad.select(F.col("dir").alias("path")) if strict else bad.limit(0).select(F.col("dir").alias("path"))).distinct()
            whole = tables.staged(rows.join(gone, "path", "left_anti").withColumn("root", F.lit(root)), "projects")
            first = whole.orderBy("path").limit(most)
            store.merge("projects", first, [*SCANNED, "tags", "root"])
            row = lambda df, path, stage, error: df.select(F.lit(root).alias("root"), path.alias("path"), F.lit(stage).alias("stage"), error.alias("error"))  # noqa: B023, E731
            problems += [row(errors, F.col("rel_path"), "read", F.col("error")), row(bad, F.col("dir"), "manifest", F.col("error"))]
            problems.append(row(whole.join(first.select("path"), "path", "left_anti"), F.col("path"), "cut", F.lit(f"beyond the first {most} projects")))
            done += 1
        except Exception as e:  # one root's trouble is its own
            broken.append((root, "", "root", str(e).splitlines()[0][:300]))
        report(0.02 + 0.83 * (k + 1) / len(roots))
    if not done:
        raise ValueError(f"no root could be scanned: {broken[0][3]}")
    out = spark.createDataFrame(broken, PROBLEMS)
    for more in problems:
        out = out.unionByName(more)
    return store.replace("problems", out)


def index(store: Store, now: Column, report: Callable = lambda p: None) -> None:
    """Symbols of all projects' files as assets, what they and the manifests say as
    capabilities and edges, and pairs of projects that share names: one plan over all roots."""
    spark = store.spark
    known = store.read("projects")
    files = None
    for row in known.select("root").distinct().collect():  # a row a root, of which a user names few
        more = owned_files(listed(spark, row["root"])).withColumn("root", F.lit(row["root"]))
        files = more if files is None else files.unionByName(more)
    ids = known.select(F.col("path").alias("dir"), F.col("root"), F.col("id").alias("project"), F.col("name").alias("project_name"), "language")
    owned = files.join(ids.select("dir", "root", "project"), ["dir", "root"])
    sources = projects.source_files(owned.withColumn("dir", F.col("project")))
    found = tables.staged(symbols.symbols(sources), "symbols")
    scored = scoring.score_symbols(found.join(ids.select(F.col("project").alias("project_id"), "project_name"), "project_id"), "project_name")
    store.merge("assets", scoring.to_assets(scored, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")), INDEXED)
    report(0.5)
    by_project = found.groupBy("project_id").agg(F.collect_set("name").alias("symbol_names"))
    needs = manifests.dependencies(owned.select(F.col("project").alias("project_id"), "name", "content"))
    deps, built_with = needs.groupBy("project_id").agg(F.collect_set("dependency").alias("dependencies")), manifests.frameworks(needs, spark)
    folders = projects.top_level(owned).select(F.col("project_id").alias("dir"), F.col("folders").alias("top_level_dirs")).join(ids.select("dir", F.col("project").alias("project_id")), "dir").drop("dir")
    signals = ids.select(F.col("project").alias("project_id"), "language")
    for more in (by_project, deps, built_with, folders):
        signals = signals.join(more, "project_id", "left")
    none = F.array().cast("array<string>")
    extracted = tables.staged(capabilities.extract(signals.withColumns({c: F.coalesce(c, none) for c in ("symbol_names", "dependencies", "frameworks", "top_level_dirs")}), rules.capability_rules(spark)), "extracted")
    nodes = capabilities.nodes(extracted)
    edges = capabilities.implements(extracted)
    contains = nodes.where("parent_id IS NOT NULL").select(
        stable_id("r", F.lit("contains"), F.col("parent_id"), F.col("id")).alias("id"), F.col("parent_id").alias("source_id"), F.lit("capability").alias("source_type"), F.lit("contains").alias("relation_type"),
        F.col("id").alias("target_id"), F.lit("capability").alias("target_type"), "confidence", none.alias("evidence"),
    )
    pairs = capabilities.similar_pairs(store.read("assets"))
    similar = pairs.select(
        stable_id("r", F.lit("similar_to"), F.col("a"), F.col("b")).alias("id"), F.col("a").alias("source_id"), F.lit("project").alias("source_type"), F.lit("similar_to").alias("relation_type"),
        F.col("b").alias("target_id"), F.lit("project").alias("target_type"), "confidence", none.alias("evidence"),
    )
    relations = tables.staged(edges.unionByName(contains).unionByName(similar), "relations")
    store.commit({"relations": relations, "capabilities": relational.project_counts(nodes, relations)})
    report(0.9)


def snapshot(store: Store) -> dict[str, DataFrame]:
    """The tables that detectors read."""
    return {name: store.read(name) for name in ("projects", "assets", "capabilities", "relations")}


def insight(store: Store, now: Column, report: Callable = lambda p: None) -> None:
    """All detectors and the opportunities; feedback and status of known ids stay."""
    known = snapshot(store)
    found = insights.detect_all(known, now).withColumns({"user_feedback": F.lit(None).cast("string"), "created_at": F.date_format(now, "yyyy-MM-dd")})
    kept = found.drop("created_at").join(store.read("insights").select("id", "created_at"), "id", "left").withColumn("created_at", F.coalesce("created_at", F.date_format(now, "yyyy-MM-dd"))) if store.has("insights") else found
    store.replace("insights", insights.with_feedback(kept, store.read("insights")) if store.has("insights") else kept)
    report(0.6)
    store.merge("opportunities", insights.opportunities(known), ["title", "source_project_ids", "source_asset_ids", "required_capabilities", "missing_capabilities", "coverage", "rating"])


def handlers(store: Store, now: Column, settings: Sequence[str] = ()) -> dict[str, Callable]:
    """For ``jobs.Runner``: a scan takes the folders of its payload, or those given, or the
    store's own enabled directories, which then know when they were scanned and what is there."""

    def scan_job(options: dict, report: Callable) -> DataFrame:
        kept = ScanSettings(store)
        roots = targets(options.get("dirs", ()), settings or kept.roots())
        found = scan(store, roots, now, options.get("most", MOST_PROJECTS), report, options.get("commit_log"), bool(options.get("strict")))
        kept.scanned(roots, now)
        return found

    return {"scan": scan_job, "index": lambda options, report: index(store, now, report), "insight": lambda options, report: insight(store, now, report)}
