"""Mixing sources to target weights, by thresholds on a hash of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, named, others, staged

WEIGHTS = (3, 1, 2)
HASH_BITS = 60
#: Bits that each histogram resolves; what is left after them is resolved exactly.
LEVELS = (10, 10)


def doc_hash(doc_id: Column) -> Column:
    """60 bits of md5; null counts as the empty string. Any engine can compute it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``by_source(source, source_size)`` with weight, target, base and rest: the source is
    taken ``base`` times whole, and ``rest`` words of it once more.

    Sources by code point, null last, weigh ``weights`` in turn. Targets stop at ``most``
    times the source's size and the excess goes to the others by weight: sources are passed
    in order of the level at which they are full, one row a source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("turn", turn).withColumn("weight", weight)
    full = (F.lit(float(most)) * F.col("source_size")) / F.col("weight")
    order = Window.orderBy("full", "turn")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = (
        ranked.withColumn("full", full)
        .withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", level)
        .withColumn("final", F.min(F.when(F.col("level") < F.col("full"), F.struct("full", "turn", "level"))).over(whole)["level"])
    )
    is_full = F.col("final").isNull() | (F.col("full") <= F.col("final"))
    target = F.when(is_full, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("final") * F.col("weight"))
    base = F.when(is_full, F.lit(most)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    return filled.withColumn("target", target).withColumn("base", base).select("source", "source_size", "weight", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("rest"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``limit``: of each source, documents with a hash below it are taken
    once more, so that their sizes come as near to ``rest`` as whole hashes allow.

    Histograms of 2^10 buckets by source: the first over all rows, the next only over the
    bucket where the budget ends, the last by the hash itself. No rows are sorted; a window
    sees at most 2^10 sums of a source, then about one in 2^20 of its rows.
    """
    state = wanted.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    left = HASH_BITS
    for take in (*LEVELS, left - sum(LEVELS)):
        left -= take
        inside = sizes.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("d.hash", left + take) == F.col("s.prefix")))
        sums = inside.groupBy("s.source", "s.rest", "s.before", F.shiftright("d.hash", left).alias("prefix")).agg(F.sum("d.size").alias("sum"))
        cum = F.col("before") + F.sum("sum").over(Window.partitionBy("source").orderBy("prefix"))
        over = sums.withColumn("cum", cum).where("cum > rest")
        state = over.groupBy("source", "rest").agg(F.min_by(F.struct("prefix", (F.col("cum") - F.col("sum")).alias("before"), "cum"), "prefix").alias("x")).select("source", "rest", "x.prefix", "x.before", "x.cum")
        if left:
            state = state.drop("cum")
    nearer = (F.col("cum") - F.col("rest")) < (F.col("rest") - F.col("before"))
    limit = state.select(F.col("source").alias("source_"), F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("limit"))
    return wanted.join(limit, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_").withColumn("limit", F.coalesce("limit", F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0)).cast("long")))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes the row.

    Size: number of words (null text: 0). A null source is a source. Rows that share a
    doc_id are taken alike; a null doc_id hashes like an empty one. Reruns agree: the hash
    depends on doc_id alone. Columns of docs with one of the new names, in whatever case, are
    replaced. An
    empty table gives an empty one.

    Texts are read once for the sizes, which are written to the shared folder; the sources'
    sums are one row a source, so the rows meet them in a join that moves no text as long as
    that table is small enough to broadcast, and in a skew-splitting join beyond that.
    """
    kept = others(docs, "size", "source_size", "target", "copies")
    sizes = staged(docs.select("source", doc_hash(F.col("doc_id")).alias("hash"), size_of(F.col("text")).alias("size")), "sizes")
    wanted = staged(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    source, size, target, base, limit, own = fresh(docs, "of_source", "source_sum", "source_target", "base", "limit", "own_size")
    limits = staged(thresholds(sizes, wanted), "thresholds").select(F.col("source").alias(source), F.col("source_size").alias(size), F.col("target").alias(target), F.col("base").alias(base), F.col("limit").alias(limit))
    met = docs.withColumn(own, size_of(F.col("text"))).join(limits, F.col("source").eqNullSafe(named(source)))
    copies = named(base) + (doc_hash(F.col("doc_id")) < named(limit)).cast("long")
    return met.select(*kept, named(own).alias("size"), named(size).alias("source_size"), named(target).alias("target"), copies.alias("copies"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken."""
    (marker,) = fresh(docs, "copy")
    columns = [named(c) for c in docs.columns]
    # Columns of docs that mix() would replace travel in a struct.
    packed = docs.select("doc_id", "source", "text", F.struct(*columns).alias(marker))
    taken = mix(packed, **options).where("copies > 0")
    return taken.select(named(marker), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(f"{marker}.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((turn - 1) % 3 AS INT) + 1] AS weight FROM s),
f AS (SELECT *, CAST(2.0 AS DOUBLE) * source_size / weight AS fullat, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, (total - CAST(coalesce(sum(2 * source_size) OVER p, 0) AS DOUBLE)) / CAST(weights - coalesce(sum(weight) OVER p, 0) AS DOUBLE) AS level
      FROM f WINDOW p AS (ORDER BY fullat, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, (SELECT level FROM l WHERE level < fullat ORDER BY fullat, turn LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR fullat <= final THEN CAST(2.0 AS DOUBLE) * source_size ELSE final * weight END AS target,
             final IS NULL OR fullat <= final AS is_full FROM m),
b AS (SELECT *, CASE WHEN is_full THEN 2 ELSE CAST(floor(target / source_size) AS BIGINT) END AS base FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(size) OVER (PARTITION BY d.source, h) AS same
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN rest <= 0 THEN 0 WHEN cum <= rest THEN 1
         WHEN cum - same <= rest AND cum - rest < rest - (cum - same) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
