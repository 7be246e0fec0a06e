"""Answers over search hits: context, citations and what is said without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import citation_ids

MOST_HITS, MOST_CITATIONS, MOST_TURNS = 12, 6, 6


def context(hits: DataFrame) -> DataFrame:
    """The hits that a model may cite, numbered."""
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))
    return hits.orderBy(F.col("score").desc(), "id").limit(MOST_HITS).withColumn("place", rank).select("place", "kind", "id", "title", "score")


def history(turns: DataFrame) -> DataFrame:
    """The last turns of each conversation, in order."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("_n", rank).where(F.col("_n") <= MOST_TURNS).drop("_n").orderBy("conv_id", "turn")


def prompt(question: str, hits: DataFrame) -> DataFrame:
    """One row: the numbered material, then the question."""
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("kind"), F.lit(": "), F.col("title"))
    listed = hits.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("material"))
    return listed.select(F.concat(F.lit("Material:\n"), F.col("material"), F.lit("\n\nQuestion: "), F.lit(question.strip())).alias("prompt"))


def verify(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``answers(answer_id, text)`` with the citations that were offered, in order of first
    appearance, and how many others there were."""
    cited = answers.select("answer_id", F.posexplode(citation_ids(F.col("text"))).alias("pos", "id"))
    met = cited.join(hits.select("id", "kind").distinct(), "id", "left")
    known = met.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"]).alias("citations"), F.count_if(F.col("kind").isNull()).alias("rejected"))
    none = F.array().cast("array<string>")
    return answers.join(known, "answer_id", "left").withColumns({"citations": F.coalesce("citations", none), "rejected": F.coalesce("rejected", F.lit(0))})


def plain_answer(hits: DataFrame) -> DataFrame:
    """The answer without a model: how many hits of which kind, and the best of them."""
    counts = hits.groupBy("kind").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    summary = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind"))), lambda x: F.concat((-x["o"]).cast("string"), F.lit(" "), x["kind"])), ", ").alias("summary"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    best = hits.orderBy(F.col("score").desc(), "id").limit(MOST_CITATIONS).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id"))), lambda x: x["id"]).alias("citations"))
    one = F.lit(1).alias("one")
    met = summary.select("*", one).join(best.select("*", one), "one").drop("one")
    return met.withColumn("answer", F.when(F.col("hits") == 0, F.lit("There is no material on this yet.")).otherwise(F.concat(F.lit("Found: "), F.col("summary"), F.lit("."))))


def route(sensitive: Column, deep: Column, cloud: Column) -> Column:
    """Sensitive work stays local, and so does all work where no cloud is set up."""
    return F.when(sensitive | ~cloud, "local").when(deep, "deep").otherwise("fast")


def trust(profiles: DataFrame, files: DataFrame, assets: DataFrame) -> DataFrame:
    """``profiles(project_id, files, assets)`` with what of their evidence really exists and
    the share of it; no evidence: 0."""
    real = files.groupBy("project_id").agg(F.collect_set("rel_path").alias("_f")).join(assets.groupBy("project_id").agg(F.collect_set("id").alias("_a")), "project_id", "full")
    met = profiles.join(real, "project_id", "left")
    keep = lambda c, r: F.array_intersect(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(r, F.array().cast("array<string>")))
    n = F.size(F.coalesce("files", F.array().cast("array<string>"))) + F.size(F.coalesce("assets", F.array().cast("array<string>")))
    found = met.withColumns({"real_files": keep(F.col("files"), F.col("_f")), "real_assets": keep(F.col("assets"), F.col("_a"))}).withColumn("claimed", n)
    return found.withColumn("trust", F.when(F.col("claimed") == 0, F.lit(0.0)).otherwise((F.size("real_files") + F.size("real_assets")) / F.col("claimed"))).drop("_f", "_a")
