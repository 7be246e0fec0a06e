"""Views of the relation graph: hubs, neighbourhoods, and what is assembled of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enums import SYMMETRIC, VALUES

MOST_NODES, LIMIT_NODES, MOST_EDGES, LIMIT_EDGES = 120, 400, 400, 1500


def parse_list(text: str | None, enum: str) -> list[str] | None:
    """Comma-separated values of an enumeration; empty: None; an unknown one is an error."""
    found = [x.strip() for x in (text or "").split(",") if x.strip()]
    for x in found:
        if x not in VALUES[enum]:
            raise ValueError(f"{x} is not one of {', '.join(VALUES[enum])}")
    return found or None


def ends(relations: DataFrame) -> DataFrame:
    """node, kind, other, other_kind: every edge from both of its ends, in one reading."""
    one = lambda a, b: F.struct(F.col(f"{a}_id").alias("node"), F.col(f"{a}_type").alias("kind"), F.col(f"{b}_id").alias("other"), F.col(f"{b}_type").alias("other_kind"))
    return relations.select(F.explode(F.array(one("source", "target"), one("target", "source"))).alias("e"), "confidence", "id").select("e.*", "confidence", "id")


def degrees(relations: DataFrame) -> DataFrame:
    return ends(relations).groupBy("node", "kind").agg(F.count("*").alias("degree"))


def hubs(relations: DataFrame, capabilities: DataFrame, layers: Sequence[str] | None = None, most: int = MOST_NODES) -> DataFrame:
    """The nodes of the overview: capabilities with edges, of the layers asked, and projects,
    by degree, then project_count, then key."""
    weights = capabilities.select(F.col("id").alias("node"), "layer", "project_count")
    known = degrees(relations).where(F.col("kind").isin("capability", "project")).join(weights, "node", "left")
    wanted = F.col("layer").isin(list(layers)) if layers else F.lit(True)
    kept = known.where((F.col("kind") == "project") | wanted)
    return kept.orderBy(F.col("degree").desc(), F.coalesce("project_count", F.lit(0)).desc(), "node").limit(min(max(most, 1), LIMIT_NODES)).select("node", "kind")


def focus(relations: DataFrame, centre: str, most: int = MOST_NODES, expand: bool = False) -> DataFrame:
    """The centre, its neighbours by confidence, and theirs if ``expand``: node, hop."""
    both = ends(relations)
    one = both.where(F.col("node") == centre).groupBy(F.col("other").alias("node"), F.col("other_kind").alias("kind")).agg(F.max("confidence").alias("confidence")).where(F.col("node") != centre).withColumn("hop", F.lit(1))
    start = both.where(F.col("node") == centre).select("node", "kind").limit(1).select("node", "kind", F.lit(2.0).alias("confidence"), F.lit(0).alias("hop"))
    found = start.unionByName(one)
    if expand:
        near = found.select("node")
        two = both.join(one.select("node"), "node", "left_semi").groupBy(F.col("other").alias("node"), F.col("other_kind").alias("kind")).agg(F.max("confidence").alias("confidence")).join(near, "node", "left_anti").withColumn("hop", F.lit(2))
        found = found.unionByName(two)
    return found.orderBy("hop", F.col("confidence").desc(), "node").limit(min(max(most, 1), LIMIT_NODES)).select("node", "kind", "hop")


def node_size(degree: Column, weight: Column) -> Column:
    return F.round(F.least(F.greatest(9 + 7 * F.log(F.greatest(degree, weight, F.lit(1))), F.lit(9.0)), F.lit(34.0)), 1)


def labels(capabilities: DataFrame, projects: DataFrame, assets: DataFrame) -> DataFrame:
    """node, label: a capability's name, else a project's, else an asset's."""
    parts = [df.select(F.col("id").alias("node"), F.col("name").alias("label"), F.lit(i).alias("rank")) for i, df in enumerate((capabilities, projects, assets))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("node").agg(F.min_by("label", "rank").alias("label"))


def assemble(selected: DataFrame, relations: DataFrame, names: DataFrame, weights: DataFrame, most: int = MOST_EDGES) -> dict[str, DataFrame]:
    """nodes, edges and stats. Nodes without a label are dropped; only edges with both ends
    among the nodes stay, at most ``most`` of them by confidence, then id."""
    known = selected.join(names, "node")
    inside = relations.join(known.select(F.col("node").alias("source_id")), "source_id", "left_semi").join(known.select(F.col("node").alias("target_id")), "target_id", "left_semi")
    kept = inside.orderBy(F.col("confidence").desc(), "id").limit(min(max(most, 0), LIMIT_EDGES)).withColumn("symmetric", F.col("relation_type").isin(SYMMETRIC))
    degree = ends(kept).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = known.join(degree, "node", "left").join(weights, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("weight", F.coalesce("weight", F.lit(0)))
    nodes = nodes.withColumn("size", node_size(F.col("degree"), F.col("weight"))).orderBy(F.col("degree").desc(), "node")
    count = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    stats = count(nodes, "nodes").join(count(kept, "edges"), "one").join(count(inside, "inside"), "one").join(count(relations, "all"), "one").join(count(nodes.where("degree = 0"), "isolated"), "one")
    return {"nodes": nodes, "edges": kept, "stats": stats.select("nodes", "edges", (F.col("inside") - F.col("edges")).alias("omitted"), (F.col("all") - F.col("inside")).alias("dangling"), "isolated")}


def legend(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "relation_type")


def rings(nodes: DataFrame, centre: str, radius: float = 120.0, step: float = 90.0, per_ring: int = 12) -> DataFrame:
    """x, y of nodes on rings around the centre, in order of degree."""
    rank = F.row_number().over(Window.orderBy(F.when(F.col("node") == centre, 0).otherwise(1), F.col("degree").desc(), "node")) - 2
    ring, place = F.floor(F.col("_r") / per_ring), F.pmod("_r", F.lit(per_ring))
    far = F.when(F.col("_r") < 0, 0.0).otherwise(radius + ring * step)
    angle = place * (2 * 3.141592653589793 / per_ring)
    return nodes.withColumn("_r", rank).withColumns({"x": F.round(far * F.cos(angle), 2), "y": F.round(far * F.sin(angle), 2)}).drop("_r")


def node_legend(nodes: DataFrame) -> DataFrame:
    """kind, n for all kinds of entities, zeros included, in domain order."""
    kinds = nodes.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in VALUES["entity_kind"]])).alias("ordinal", "kind"))
    return kinds.join(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), "ordinal")


def locate(entity: str, projects: DataFrame, capabilities: DataFrame, assets: DataFrame, relations: DataFrame) -> DataFrame:
    """id, kind of an entity: a project, else a capability, else an asset, else what an edge
    says of it; no rows where nothing knows it."""
    parts = [df.where(F.col("id") == entity).select("id", F.lit(kind).alias("kind"), F.lit(rank).alias("rank")) for rank, (kind, df) in enumerate((("project", projects), ("capability", capabilities), ("asset", assets)))]
    seen = ends(relations).where(F.col("node") == entity).select(F.col("node").alias("id"), "kind", F.lit(3).alias("rank"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(seen)
    return every.groupBy("id").agg(F.min_by("kind", F.struct("rank", "kind")).alias("kind"))


def neighbourhood(relations: DataFrame, entity: str) -> DataFrame:
    """relation_type, outgoing, n, confidence: how an entity hangs together with others."""
    out = F.col("source_id") == entity
    touching = relations.where(out | (F.col("target_id") == entity)).withColumn("outgoing", out)
    return touching.groupBy("relation_type", "outgoing").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")).orderBy(F.col("n").desc(), "relation_type", "outgoing")
