"""Commit logs as a source: exported logs of many repositories, read in splits.

A line of a log is a commit, its five fields parted by the unit separator:

    git -C DIR log --max-count=20000 --format="DIR%x1f%H%x1f%ae%x1f%aI%x1f%s"
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_path, parse_time
from .projects import MOST_COMMITS, commits

#: Subjects that are kept of a project, and the most that may be asked for.
SUBJECTS, MOST_SUBJECTS = 20, 200


def read_log(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(commits, rejected): project_id (its folder), hash, author, date, subject of each line;
    and the lines that are no commits, with the file and what is wrong. Blank lines are
    nothing. A commit that several exports hold counts once; subjects may hold separators."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    f = F.split("value", "\x1f", 5)
    cut = lines.select("file", "value", F.size(f).alias("n"), *[F.trim(F.get(f, i)).alias(name) for i, name in enumerate(("folder", "hash", "author", "date", "subject"))])
    wrong = F.when(F.col("n") < 5, "fewer than five fields").when(~F.col("hash").rlike("^[0-9a-fA-F]{7,64}$"), "no commit id").when(F.col("folder") == "", "no folder").when(parse_time(F.col("date")).isNull(), "no date")
    judged = cut.withColumn("wrong", wrong)
    good = judged.where("wrong IS NULL").select(normalize_path(F.col("folder")).alias("project_id"), "hash", "author", "date", "subject").dropDuplicates(["project_id", "hash"])
    return good, judged.where("wrong IS NOT NULL").select("file", "value", F.col("wrong").alias("error"))


def newest(log: DataFrame, most: int) -> DataFrame:
    """At most ``most`` commits a project, the latest first; ties by hash."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(parse_time(F.col("date")).desc(), "hash"))
    return log.withColumn("rank", rank).where(F.col("rank") <= most)


def history(log: DataFrame, now: Column, subjects: int = SUBJECTS, most: int = MOST_COMMITS) -> DataFrame:
    """project_id, commits, first_commit, last_commit, recent (of 90 days), authors, and
    subjects: those of the latest commits that have one, newest first, 1 to 200. Of projects
    with ``most`` commits or more the latest count, and the first one is not known."""
    facts = commits(newest(log, most).drop("rank"), now, most)
    few = min(max(subjects, 1), MOST_SUBJECTS)
    last = newest(log, few).where(F.trim("subject") != "").groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "subject"))), lambda x: x["subject"]).alias("subjects"))
    return facts.join(last, "project_id", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))
