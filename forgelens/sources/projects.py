"""Projects on disk: files, markers, counts, READMEs and commit logs as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import any_of, idle_days, parse_time, stable_id
from ..operators import scoring

MOST_SOURCE, MOST_COUNTED, MOST_FILES, MOST_DEPTH = 512 * 1024, 2 * 1024 * 1024, 3000, 10
MOST_COMMITS = 20_000
#: Folders below a project, and files of it, that are counted.
COUNT_DEPTH, COUNT_FILES = 8, 20_000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, name, length, modified, content of all files below ``root``. What is
    not selected later is not read: content is a column like any other."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = F.regexp_replace("path", r"^\w+:/*", "/")
    rel = F.substring(clean, len("/" + root.split(":", 1)[-1].strip("/")) + 2, 1 << 20)
    return found.select(clean.alias("path"), rel.alias("rel_path"), F.element_at(F.split(rel, "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def excluded(rel_path: Column) -> Column:
    """A part of the path is on the list of what is never entered."""
    parts = F.split(rel_path, "/")
    return F.exists(parts, lambda p: p.isin(rules.EXCLUDED) | p.endswith(".egg-info"))


def secret(name: Column) -> Column:
    low = F.lower(name)
    listed = low.isin([x.lower() for x in rules.EXCLUDED])
    return listed | any_of([low.endswith(x) for x in rules.SECRET_ENDS] + [low.startswith(x) for x in rules.SECRET_STARTS] + [F.contains(low, F.lit(x)) for x in rules.SECRET_PARTS])


def generated(rel_path: Column) -> Column:
    parts = F.split(F.lower(rel_path), "/")
    name = F.element_at(parts, -1)
    return name.isin(rules.GENERATED_FILES) | any_of([name.endswith(x) for x in rules.GENERATED_ENDS]) | F.exists(parts, lambda p: p.isin(rules.GENERATED_FOLDERS))


def language_of(name: Column) -> Column:
    pairs = [F.lit(x) for lang, ends in rules.EXTENSIONS.items() for end in ends.split() for x in (end, lang)]
    ext = F.lower(F.substring_index(name, ".", -1))
    return F.when(F.contains(name, F.lit(".")), F.try_element_at(F.create_map(*pairs), ext))


def is_markup(language: Column) -> Column:
    return language.isin(rules.MARKUP)


def glob_regex(pattern: str) -> str:
    """A glob over / paths: ** any folders, * and ? within a name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c), i + 1
    return f"^{out}$"


def drop_globs(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Without files that a pattern names: as it is, below any folder, or as a folder."""
    for pattern in (p.strip().strip("/") for p in patterns if p.strip()):
        for variant in (pattern, f"**/{pattern}", f"**/{pattern}/**"):
            files = files.where(~F.col("rel_path").rlike(glob_regex(variant)) & ~F.col("name").rlike(glob_regex(variant)))
    return files


def detect(entries: DataFrame, spark: SparkSession) -> DataFrame:
    """dir, marker, kind and flags of the project folders among ``entries(dir, name)``."""
    markers = rules.rows(spark, [(i, f, k) for i, (f, k) in enumerate(rules.MARKERS)], ["priority", "name", "kind"])
    low = F.lower("name")
    found = entries.join(F.broadcast(markers), "name", "left").groupBy("dir").agg(
        F.min_by("name", "priority").alias("marker"), F.min_by("kind", "priority").alias("kind"), F.bool_or(F.col("name") == ".git").alias("has_git"), F.bool_or(low.startswith("readme")).alias("has_readme"),
        F.bool_or(low.isin("test", "tests", "__tests__", "spec", "specs")).alias("has_tests"), F.bool_or(low.startswith("license") | low.startswith("licence")).alias("has_license"),
        F.bool_or((low == "dockerfile") | low.startswith("docker-compose")).alias("has_docker"),
    )
    return found.where("marker IS NOT NULL OR has_git").withColumns({"marker": F.coalesce("marker", F.lit(".git")), "kind": F.coalesce("kind", F.lit("git_only"))})


def project_roots(files: DataFrame, spark: SparkSession, most_depth: int = 6) -> DataFrame:
    """The outermost project folders: dir and what ``detect`` says of them. Each file names
    its folders down to the depth; a project inside of another is part of it."""
    parts = F.split("rel_path", "/")
    depth = F.least(F.size(parts), F.lit(most_depth))
    entry = F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("dir"), F.get(parts, i - 1).alias("name")))).alias("e")
    marked = F.coalesce(F.array_position(F.transform(parts, lambda p: p == ".git"), True), F.lit(0))
    seen = files.where(~excluded(F.when(marked > 0, F.lit("")).otherwise(F.col("rel_path")))).select(entry).select("e.*").where("NOT startswith(dir, '.git')").distinct()
    found = detect(seen, spark)
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/")) - 1), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))
    inner = found.select("dir", F.explode(up).alias("outer")).where("outer <> dir").join(found.select(F.col("dir").alias("outer")), "outer").select("dir").distinct()
    return found.join(inner, "dir", "left_anti")


def assign(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files with the project folder they are in: an equal join on each file's folders."""
    parts = F.split("rel_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.withColumn("dir", F.explode(up)).join(roots, "dir")


def source_files(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """project_id, language, rel_path, text of files to index: known language, not too long,
    not generated, not secret, at most ``most`` a project by path. Name and length decide
    before the content is read; what is not UTF-8 is left out."""
    lang = language_of(F.col("name"))
    few = files.where((F.col("length") <= MOST_SOURCE) & ~generated(F.col("rel_path")) & ~secret(F.col("name")) & ~excluded(F.col("rel_path")) & (F.size(F.split("rel_path", "/")) <= MOST_DEPTH)).withColumn("language", lang).where("language IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("rel_path"))
    return few.withColumn("_n", rank).where(F.col("_n") <= most).select(F.col("dir").alias("project_id"), "language", "rel_path", F.try_validate_utf8("content").alias("text")).where("text IS NOT NULL")


def count_lines(text: Column, block: Column | None = None) -> Column:
    """total, code, comment, blank of a text: comment lines begin with //, # or --, or lie
    between /* and */; the state of blocks is carried from line to line."""
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(raw)
        opens = line.startswith("/*")
        closes = F.contains(line, F.lit("*/"))
        blank = line == ""
        comment = ~blank & (acc["inside"] | opens | line.rlike(r"^(//|#|--)"))
        inside = F.when(acc["inside"], ~closes).otherwise(opens & ~closes)
        return F.struct(inside.alias("inside"), (acc["code"] + (~blank & ~comment).cast("int")).alias("code"), (acc["comment"] + comment.cast("int")).alias("comment"), (acc["blank"] + blank.cast("int")).alias("blank"))

    done = lambda acc: F.struct((acc["code"] + acc["comment"] + acc["blank"]).alias("total"), acc["code"].alias("code"), acc["comment"].alias("comment"), acc["blank"].alias("blank"))
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return F.when(text == "", F.struct(*[F.lit(0).alias(c) for c in ("total", "code", "comment", "blank")])).otherwise(F.aggregate(lines, zero, step, done))


def top_level(files: DataFrame) -> DataFrame:
    """project_id, folders, names: what stands at the top of each project, sorted."""
    inner = F.when(F.col("dir") == "", F.col("rel_path")).otherwise(F.expr("substring(rel_path, length(dir) + 2)"))
    parts = F.split(inner, "/")
    return files.groupBy(F.col("dir").alias("project_id")).agg(
        F.array_sort(F.collect_set(F.when(F.size(parts) > 1, parts[0]))).alias("folders"), F.array_sort(F.collect_set(F.when(F.size(parts) == 1, parts[0]))).alias("names")
    )


def newest(files: DataFrame) -> DataFrame:
    """project_id, modified: the age of a project without commits."""
    return files.where(~excluded(F.col("rel_path"))).groupBy(F.col("dir").alias("project_id")).agg(F.max("modified").alias("modified"))


def language_stats(files: DataFrame, most: int = MOST_COUNTED, depth: int = COUNT_DEPTH, count: int = COUNT_FILES) -> DataFrame:
    """project_id, name, loc, files of what people wrote: down to ``depth`` folders below the
    project, and the first ``count`` of its files by path. Names and lengths decide before a
    file's content is read."""
    lang = language_of(F.col("name"))
    kept = files.where((F.col("length") <= most) & ~generated(F.col("rel_path")) & ~secret(F.col("name")) & ~excluded(F.col("rel_path"))).withColumn("language", lang).where("language IS NOT NULL")
    inner = F.size(F.split("rel_path", "/")) - F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("rel_path"))
    kept = kept.where(inner <= depth + 1).withColumn("_n", rank).where(F.col("_n") <= count)
    lines = kept.select(F.col("dir").alias("project_id"), F.col("language").alias("name"), count_lines(F.try_validate_utf8("content"))["code"].alias("n"))
    return lines.groupBy("project_id", "name").agg(F.sum("n").alias("loc"), F.count("*").alias("files"))


def primary_language(shares: DataFrame) -> DataFrame:
    """project_id, language: the largest that is not markup, else the largest."""
    return shares.groupBy("project_id").agg(F.min_by("name", F.struct(is_markup(F.col("name")), -F.col("loc"), "name")).alias("language"))


def first_paragraph(text: str | None, most_lines: int = 3, most: int = 300) -> str | None:
    """The first prose of a README: no headings, badges, HTML, quotes, tables or code."""
    out, fenced = [], False
    for raw in (text or "").splitlines():
        line = raw.strip()
        if line.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced:
            continue
        if not line or line.startswith(("#", "<", ">", "|", "![", "[![", "---", "===")):
            if out:
                break
            continue
        out.append(line)
        if len(out) == most_lines:
            break
    joined = " ".join(out)
    return (joined if len(joined) <= most else joined[: most - 3] + "…") or None


def readmes(files: DataFrame) -> DataFrame:
    """project_id, excerpt from each project's README, the shortest name first."""
    top = files.where(F.lower("name").startswith("readme") & (F.length("rel_path") == F.length("dir") + F.when(F.col("dir") == "", 0).otherwise(1) + F.length("name")))
    texts = top.groupBy(F.col("dir").alias("project_id")).agg(F.min_by(F.try_validate_utf8("content"), F.struct(F.length("name"), "name")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"project_id": frame["project_id"], "excerpt": [first_paragraph(t) for t in frame["text"]]})

    return texts.mapInPandas(run, "project_id string, excerpt string")


def commits(log: DataFrame, now: Column, most: int = MOST_COMMITS) -> DataFrame:
    """project_id, commits, first_commit, last_commit, recent, authors of
    ``log(project_id, author, date)``. At the cap the first commit is not known."""
    at = parse_time(F.col("date"))
    counted = log.withColumn("at", at).groupBy("project_id").agg(
        F.count("*").alias("commits"), F.min("at").alias("first_commit"), F.max("at").alias("last_commit"), F.count_if(F.col("at") >= now - F.expr("INTERVAL 90 DAYS")).alias("recent"), F.count_distinct("author").alias("authors")
    )
    return counted.withColumn("first_commit", F.when(F.col("commits") < most, F.col("first_commit")))


def branch(head: Column) -> Column:
    """The branch that .git/HEAD names, slashes and dots included; a detached head: null."""
    return F.nullif(F.regexp_extract(head, r"^ref: refs/heads/([^\r\n]*?)\s*(?:[\r\n]|$)", 1), F.lit(""))


def to_projects(scanned: DataFrame, now: Column) -> DataFrame:
    """Scan rows as project rows, with stable ids, health and status."""
    idle = idle_days(F.col("last_commit").cast("timestamp"), F.col("modified").cast("timestamp"), now)
    n, loc = F.coalesce("commits", F.lit(0)), F.coalesce("loc", F.lit(0))
    return scanned.select(
        stable_id("p", F.element_at(F.split("dir", "/"), -1), F.col("dir")).alias("id"), F.element_at(F.split("dir", "/"), -1).alias("name"), F.col("dir").alias("path"), "kind", "language", "has_git", "has_readme", "has_tests", "has_license", "has_docker",
        loc.alias("loc"), n.alias("git_commits"), F.col("last_commit").cast("string").alias("last_commit_at"), F.col("modified").cast("string").alias("updated_at"),
        scoring.health(n, F.col("has_git"), F.col("has_readme"), F.col("has_tests"), loc, idle).alias("health_score"), scoring.status(n, idle, loc).alias("status"),
    )
