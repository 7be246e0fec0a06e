"""Filter interactions: packed bitmaps of filters, labels and parts, counted by popcount.

Each partition of the judged documents makes an index: a bitset a filter (its failures) and
a label, over the rows of each part of the partition. For each subset of the filters, AND-NOT
over the bitsets leaves the survivors, and popcount counts them, the good and the toxic ones
among them. Partitions send these counts alone, and counts add up. All else follows from
the survivors N(S) of each subset S: a filter f after those of S removes N(S) - N(S + f).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let

#: The filters; E, which knows other documents, comes last.
FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits and digest of each row of ``docs(doc_id, text, lang)``: bit i says
    that the row fails filter i of A to D; the digest tells texts apart. One scan.

    Null text: empty; null lang: the part of the empty string."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    measured = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"), counted.alias("w"))
    failed = [F.col("w.n") < 200, 100 * F.col("w.d") < 50 * F.col("w.n"), 100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]
    return measured.select("doc_id", "part", _bits(failed), F.unhex(F.sha2("text", 256)).alias("digest"))


def _bits(failed: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)]).alias("bits")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (all five filters), good, toxic of each row of ``docs``.

    E fails where a smaller doc_id has the same text. The least doc_id of each text comes
    from an aggregate that combines on the map side, and goes back by (doc_id, digest), not by
    digest, so that a group of copies, however large, is in no task as a whole. A row without
    doc_id has no smaller one and is none. Rows that share doc_id and text are all first or
    all later. ``labels(doc_id, quality, toxic)``: a document with several rows is good (or
    toxic) if one of them says 1; nulls say nothing.
    """
    rows = failures(docs)
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    met = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return met.select("part", (F.col("bits") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).cast("int").alias("bits"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivors(bits: np.ndarray, marks: list[np.ndarray]) -> list[list[int]]:
    """For each subset of the filters (as a number) how many rows none of its filters fails:
    of all rows, and of those of each mark. Rows' bits are packed, 64 to a word."""
    pack = lambda x: np.packbits(np.concatenate([x, np.zeros(-len(x) % 64, bool)])).view(np.uint64)
    fails = [pack(bits >> i & 1 == 1) for i in range(len(FILTERS))]
    of = [pack(m) for m in marks]
    left = [pack(np.ones(len(bits), bool))]
    for subset in range(1, 1 << len(FILTERS)):
        last = subset.bit_length() - 1
        left.append(left[subset & ~(1 << last)] & ~fails[last])
    return [[int(np.bitwise_count(x & m).sum()) for m in (x, *of)] for x in left]


#: Rows that a partition gathers before it packs them.
ROWS = 1 << 18


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, subset, n, good, toxic of a partition. Counts of up to as many parts as it takes
    are held; beyond that they are sent, and later ones are added to them by Spark."""
    held: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        parts, tables = list(held), np.array(list(held.values()), np.int64).reshape(-1, 1 << len(FILTERS), len(COUNTS))
        subsets = np.tile(np.arange(1 << len(FILTERS)), len(parts))
        held.clear()
        flat = tables.reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(parts, object), 1 << len(FILTERS)), pa.string()), pa.array(subsets, pa.int32()), *[pa.array(flat[:, i]) for i in range(len(COUNTS))]], ["part", "subset", *COUNTS])

    def index(some: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(some).combine_chunks()
        coded = pc.dictionary_encode(table["part"]).combine_chunks()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        bits, marks = table["bits"].to_numpy()[order], [table[c].to_numpy(zero_copy_only=False)[order] for c in ("good", "toxic")]
        ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary)), "right").tolist()
        for part, a, b in zip(coded.dictionary.to_pylist(), [0, *ends], ends, strict=False):
            counts = np.array(survivors(bits[a:b], [m[a:b] for m in marks]), np.int64)
            held[part] = held[part] + counts if part in held else counts

    gathered, n = [], 0
    for batch in batches:
        gathered.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            index(gathered)
            gathered, n = [], 0
            if len(held) > 10_000:
                yield flush()
    if gathered:
        index(gathered)
    if held:
        yield flush()


def subsets(rows: DataFrame) -> DataFrame:
    """part, subset, n, good, toxic: the survivors of each subset of the filters, over all of
    ``rows(part, bits, good, toxic)``. No part is ever in one task; its counts are."""
    return rows.select("part", "bits", "good", "toxic").mapInArrow(_count, "part string, subset int, n long, good long, toxic long").groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in COUNTS])


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step of each order of the filters, from
    ``subsets``. An empty table has no parts and no rows.

    ``shapley``: a subset S stands before filter f in |S|! * (4 - |S|)! of the orders."""
    table = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct(*COUNTS)))).alias("t"))  # 32 entries
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = table.select("part", "t", F.explode(orders).alias("filter_order")).select("part", "t", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    mask = lambda letters: reduce(lambda a, b: a + b, [F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)])
    first = lambda n: F.substring(F.col("filter_order"), F.lit(1), n)
    named = steps.select("part", "filter_order", "step", "t", mask(first(F.col("step") - 1)).alias("before"), mask(first(F.col("step"))).alias("after"))
    left = lambda subset, c="n": F.col("t")[subset][c]
    f, every = F.col("after") - F.col("before"), (1 << len(FILTERS)) - 1
    most = len(FILTERS) - 1
    share = reduce(
        lambda a, b: a + b,
        [F.when(f.bitwiseAND(s) == 0, factorial(s.bit_count()) * factorial(most - s.bit_count()) * (left(F.lit(s)) - left(F.lit(s) + f))).otherwise(F.lit(0)) for s in range(every)],
    )
    removed = left(F.col("before")) - left(F.col("after"))
    return named.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), left(F.col("after")).alias("kept"), removed.alias("removed"),
        (left(F.lit(0)) - left(f) - removed).alias("redundant"), (left(F.lit(every) - f) - left(F.lit(every))).alias("unique_fails"),
        *[(left(F.col("before"), c) - left(F.col("after"), c)).alias(f"{c}_lost") for c in ("good", "toxic")], share.cast("long").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return interactions(subsets(judged(docs.select("doc_id", "text", "lang"), labels)))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM d LEFT JOIN marks USING (doc_id)),
bits AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, good, toxic FROM f),
kinds AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM bits GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p JOIN l q ON q.x <> p.x JOIN l r ON r.x NOT IN (p.x, q.x) JOIN l s ON s.x NOT IN (p.x, q.x, r.x) JOIN l u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, left(filter_order, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
seen AS (
  SELECT part, filter_order, step, letter,
         fails <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone, contains(fails, letter) AS hit, fails = letter AS alone, n, good, toxic
  FROM steps, kinds),
counted AS (
  SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""
