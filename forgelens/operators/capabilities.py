"""Capabilities of projects, from what their dependencies, names and folders say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug, split_identifier, stable_id

SYSTEMS = ["rust", "go", "c++"]


def normalize(c: Column) -> Column:
    return F.translate(F.lower(c), "_-./+:", "      ")


def signal_text(signals: DataFrame) -> DataFrame:
    """project_id, text, language from ``signals(project_id, dependencies, frameworks,
    symbol_names, top_level_dirs, language)``."""
    parts = F.flatten(F.transform("symbol_names", split_identifier))
    words = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (F.col("dependencies"), F.col("frameworks"), F.col("symbol_names"), parts, F.col("top_level_dirs"))])
    return signals.select("project_id", normalize(F.array_join(words, " ")).alias("text"), "language")


def extract(signals: DataFrame, rules: DataFrame, floor: float = 0.55) -> DataFrame:
    """project_id, capability, domain, implementation, confidence, signals.

    ``rules`` has one row a needle and a size fixed by its table. Signals are cut to words,
    and a needle's first word finds them by an equal join; whole needles are then verified
    in the text with alphanumeric bounds. Of a capability's rules the strongest counts, all
    their signals are kept; three hits more add at most 0.09.
    """
    text = signal_text(signals)
    bare = F.trim(normalize(F.regexp_replace("needle", r"^\*", "")))
    needles = rules.select("*", bare.alias("bare"), F.startswith(F.col("needle"), F.lit("*")).alias("stem")).withColumn("head", F.split("bare", " ")[0])
    words = text.select("project_id", F.explode(F.array_distinct(F.split("text", "[^a-z0-9]+"))).alias("word")).where("word <> ''")
    exact = words.join(F.broadcast(needles.where(~F.col("stem") | F.contains("bare", F.lit(" ")))), F.col("word") == F.col("head"))
    stems = words.join(F.broadcast(needles.where("stem AND NOT contains(bare, ' ')")), F.startswith("word", F.col("head")))
    found = exact.unionByName(stems).join(text.select("project_id", "text"), "project_id")
    at = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.col("bare"), F.lit(r"\E"), F.when(F.col("stem"), "").otherwise(r"(?![A-Za-z0-9])"))
    hits = found.where(F.regexp_like("text", at)).select("project_id", "rule", "capability", "domain", "implementation", "base", "needle").distinct()
    by_rule = hits.groupBy("project_id", "rule", "capability", "domain", "implementation", "base").agg(F.collect_set("needle").alias("signals"))
    strength = F.least(F.col("base") + F.least((F.size("signals") - 1) * 0.03, F.lit(0.09)), F.lit(1.0))
    best = by_rule.withColumn("strength", strength).groupBy("project_id", "capability").agg(
        F.max("strength").alias("confidence"),
        F.max_by("domain", F.struct("strength", -F.col("rule"))).alias("domain"),
        F.max_by("implementation", F.when(F.col("implementation").isNotNull(), F.struct("strength", -F.col("rule")))).alias("implementation"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"),
    )
    systems = signals.where(F.lower("language").isin(SYSTEMS)).select(
        "project_id", F.lit("Systems Programming").alias("capability"), F.lit(0.55).alias("confidence"), F.lit("infrastructure").alias("domain"), F.lit(None).cast("string").alias("implementation"), F.array("language").alias("signals")
    )
    return best.unionByName(systems).where(F.col("confidence") >= floor).orderBy("project_id", F.col("confidence").desc(), "capability")


def nodes(found: DataFrame) -> DataFrame:
    """The three layers that ``extract`` implies: id, name, layer, parent_id, confidence."""
    domain, capability = F.concat(F.lit("cap_domain_"), F.lower("domain")), F.concat(F.lit("cap_"), slug(F.col("capability")))
    implementation = F.concat(F.lit("impl_"), slug(F.col("capability")), F.lit("_"), slug(F.col("implementation")))
    row = lambda i, name, layer, parent, c: F.struct(i.alias("id"), name.alias("name"), F.lit(layer).alias("layer"), parent.alias("parent_id"), c.alias("confidence"))
    layers = F.array(
        row(domain, F.col("domain"), "domain", F.lit(None).cast("string"), F.lit(1.0)),
        row(capability, F.col("capability"), "capability", domain, F.col("confidence")),
        row(implementation, F.col("implementation"), "implementation", capability, F.col("confidence") * 0.95),
    )
    return found.select(F.explode(layers).alias("n")).select("n.*").where("name IS NOT NULL").groupBy("id", "name", "layer", "parent_id").agg(F.max("confidence").alias("confidence"))


def implements(found: DataFrame) -> DataFrame:
    """A project's edges to its capabilities."""
    target = F.concat(F.lit("cap_"), slug(F.col("capability")))
    return found.select(
        stable_id("r", F.lit("implements"), F.col("project_id"), target).alias("id"), F.col("project_id").alias("source_id"), F.lit("project").alias("source_type"),
        F.lit("implements").alias("relation_type"), target.alias("target_id"), F.lit("capability").alias("target_type"), "confidence", F.col("signals").alias("evidence"),
    )


#: Projects of a name that one task joins with as many others at once.
BLOCK = 1000


def similar_pairs(assets: DataFrame, least: int = 2, block: int = BLOCK) -> DataFrame:
    """Projects that share asset names: a, b, confidence, names.

    Pairs of the projects of a name are the result itself; a name's projects are first made
    distinct. Where several names give a pair, the last name in order decides. A name of more
    than ``block`` projects is split into blocks, and each two of its blocks meet in a group of
    their own, so that no task holds a whole name; pairs are combined before they are dealt.
    """
    key = F.lower("name").alias("key")
    groups = assets.groupBy(key).agg(F.count_distinct("project_id").alias("n"), F.avg("reuse_score").alias("avg")).where(F.col("n") >= max(least, 2))
    blocks = F.ceil(F.col("n") / block)
    members = assets.select(key, F.col("project_id").alias("p")).distinct().join(groups, "key").withColumns({"blocks": blocks.cast("int"), "own": F.pmod(F.xxhash64("p"), blocks).cast("int")})
    x = members.select("key", "n", "avg", F.col("p").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    y = members.select("key", F.col("p").alias("y"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"))
    base = F.when(F.col("n") == 2, 0.62).when(F.col("n") == 3, 0.72).when(F.col("n") == 4, 0.80).otherwise(0.86)
    met = x.join(y, ["key", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "key", F.least(base + F.col("avg") * 0.12, F.lit(0.95)).alias("confidence"))
    return pairs.groupBy("a", "b").agg(F.max_by("confidence", "key").alias("confidence"), F.count("*").alias("names"))


def best_per_capability(found: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("capability").orderBy(F.col("confidence").desc(), "project_id"))
    return found.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")
