"""Near-duplicates: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, WordHashes, binary, discard, mix, per_slice, staged, word_hashes
from .graphs import components

#: Coordinates in a band, and the chance that sets just alike enough share no band.
ROWS, MISS = 5, 1e-7
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
SKETCHES = "row long, doc_id long, n_shingles long, set_id binary, bands array<long>"
#: A block of a cluster has about this many documents and shingles.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Partners of a centre that one sorted run compares with it.
RUN = 500


def bands_for(percent: int) -> int:
    """28 bands for 85%, 41 for 80%: (1 - likeness^ROWS)^bands <= MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - min(0.999, percent / 100) ** ROWS))


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``width``: one
    shingle of them all; no words: none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    k = min(width, len(h))
    acc = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        acc = mix(acc * _ODD[0] + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set. In round i < t each element falls
    into a random bin with a random value; in round t + b all fall into bin b. A bin keeps
    the least value of the first round that reached it, so every bin fills."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), t), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat, owner = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        empty = out == np.uint64(0xFFFFFFFFFFFFFFFF)
        live = empty.any(1) if i < t else empty[:, i - t]
        if not live.any():
            if i < t:
                break
            continue
        if not live.all():
            keep = live[owner]
            x, own = flat[keep], owner[keep]
        else:
            x, own = flat, owner
        value = mix(x ^ mix(np.array([i + 1], np.uint64) * _ODD[1]))
        to = ((value >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out.reshape(-1), own * t + to, (np.uint64(i) << np.uint64(55)) | (mix(value) >> np.uint64(9)))
    return out


def _set_id(of: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(of.tobytes()) if len(of) else None


def _sketcher(width: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = word_hashes(), TaskContext.get().partitionId() << 40
        for batch in per_slice(batches, 1000):
            sets = [shingle_set((x or b"").lower().split(), hashes, width) for x in binary(batch.column("text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = sketch([sets[i] for i in full], n_bands * ROWS).reshape(len(full), n_bands, ROWS)
            keys = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), (len(full), n_bands))
            for j in range(ROWS):
                keys = mix(keys * _ODD[2] + rows[:, :, j])
            bands: list = [None] * len(sets)
            for i, of in zip(full, keys.astype(np.int64).tolist(), strict=True):
                bands[i] = of
            columns = (np.arange(row, row + len(sets)), batch.column("doc_id").cast(pa.int64()), [len(s) for s in sets], [_set_id(s) for s in sets], bands)
            row += len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["row", "doc_id", "n_shingles", "set_id", "bands"])

    return run


def _of_set(width: int):
    """The rows whose text has the set that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in per_slice(batches, 500):
            found = [_set_id(shingle_set((x or b"").lower().split(), hashes, width)) for x in binary(batch.column("text"))]
            keep = pa.array([i for i, (a, b) in enumerate(zip(found, batch.column("set_id").to_pylist(), strict=True)) if a == b], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("node", "text")], ["node", "text"])

    return run


def _alike(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * same >= percent * (len(left) + len(right) - same)


def _verifier(width: int, percent: int):
    """Sorted runs: a centre (b null), then those to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, left = word_hashes(), np.zeros(0, np.uint64)
        for batch in per_slice(batches, 500):
            keep = []
            for i, (b, text) in enumerate(zip(batch.column("b").to_pylist(), binary(batch.column("text")), strict=True)):
                of = shingle_set((text or b"").lower().split(), hashes, width)
                if b is None:
                    left = of
                elif _alike(left, of, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that are links. A centre's text moves once for each RUN of
    its partners, so that a hot centre is many runs, and no pair carries two texts."""
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    to = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), "b")
    partners = to.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "run", "b", "text")
    centres = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("b"))
    sent = partners.unionByName(centres.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "run", "b", "text"))
    return sent.repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first()).select("a", "b", "text").mapInArrow(_verifier(width, percent), "a long, b long")


def _shingler(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in per_slice(batches, 200):
            sets = [shingle_set((x or b"").lower().split(), hashes, width) for x in binary(batch.column("text"))]
            ids = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64))], ["node", "shingle"])

    return run


MATES = "cluster long, i int, j int, node long, mates binary"


def _block_bounds(percent: int):
    """Two blocks of a cluster, without texts: of the pairs of different components that share
    a band and that their bounds allow, each document with its partners of a greater place,
    and the partners as rows of their own."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        cluster, node, n, part, most, block, i, j = (table.column(c).to_numpy() for c in ("cluster", "node", "n", "component", "most", "block", "i", "j"))
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        mates: dict[int, bytes] = {}
        for a in left.tolist():
            may = right[right > a] if i[0] == j[0] else right
            may = may[part[may] != part[a]]
            least = np.minimum(most[a], most[may])
            may = may[100 * least >= percent * (n[a] + n[may] - least)]
            may = may[(bands[may] == bands[a]).any(1)]
            if len(may):
                mates[a] = node[may].tobytes()
                for b in may.tolist():
                    mates.setdefault(b, b"")
        at = list(mates)
        k = len(at)
        return pa.table({"cluster": pa.array(np.full(k, cluster[0])), "i": pa.array(np.full(k, i[0], np.int32)), "j": pa.array(np.full(k, j[0], np.int32)), "node": pa.array(node[at]), "mates": pa.array([mates[x] for x in at], pa.binary())})

    return run


def _block_links(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, links = word_hashes(), ([], [])
        nodes = table.column("node").to_pylist()
        sets = {a: shingle_set((x or b"").lower().split(), hashes, width) for a, x in zip(nodes, binary(table.column("text")), strict=True)}
        for a, mates in zip(nodes, table.column("mates").to_pylist(), strict=True):
            for b in np.frombuffer(mates, np.int64).tolist():
                if _alike(sets[a], sets[b], percent):
                    links[0].append(a)
                    links[1].append(b)
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return run


def _between_components(left: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components, of the documents that the bounds leave: those that share
    buckets form clusters, a cluster is dealt out to blocks, and each pair of blocks is a
    task of its own, first over sizes and bands. Texts go only where a pair passes, once for
    each pair of blocks; no pair of documents becomes a row unless it is a link."""
    hubs = left.groupBy("band").agg(F.min("node").alias("hub"))
    clusters = components(left.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = left.select("node", "n", "component", "most").distinct().join(clusters.select("node", F.col("component").alias("cluster")), "node")
    many = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    sized = members.join(members.groupBy("cluster").agg(many), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = staged(sized.join(nodes.select("node", "bands"), "node"), "blocks")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = full.select("*", others).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    mates = staged(dealt.groupBy("cluster", "i", "j").applyInArrow(_block_bounds(percent), MATES), "mates")
    return mates.join(texts, "node").groupBy("cluster", "i", "j").applyInArrow(_block_links(width, percent), "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, odd: DataFrame, width: int) -> DataFrame:
    """node, text for ``wanted(node, doc_id, set_id)``. Where a doc_id has texts of several
    sets (``odd``), the text of just the set that is wanted."""
    read = docs.where(F.col("text").rlike(WORD))
    plain = read.join(wanted.select("doc_id", "node").join(odd, "doc_id", "left_anti").hint("shuffle_hash"), "doc_id").groupBy("doc_id", "node").agg(F.min("text").alias("text")).select("node", "text")
    if odd.isEmpty():
        return plain
    some = read.join(wanted.join(odd, "doc_id", "left_semi"), "doc_id").select("node", "set_id", "text").mapInArrow(_of_set(width), "node long, text string")
    return plain.unionByName(some.groupBy("node").agg(F.min("text").alias("text")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id, text)``.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct
    ``width``-word shingles (A-Z lower-cased); component_id is the least doc_id reachable.
    Texts without words (null, empty) have no set and give no links. Rows with a null doc_id get a
    null component and are kept. Rows that share a doc_id are one document, whose links are
    those of all its texts. Other columns are ignored; an empty table gives an empty one.

    1. One pass writes sketches; rows of equal sets become one class, a node of the graph.
    2. Classes that share a band meet in buckets. A bucket's centre, its member in the most
       and largest buckets, is verified with each of the others: a star, not all pairs.
    3. Buckets whose members are not all in one component yet are checked to the end: a member
       that has u shingles no other such document has shares at most n - u with any; what
       that bound leaves, between components, is verified by pairs of blocks.
    Verification always compares full sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = staged(docs.mapInArrow(_sketcher(width, bands_for(percent)), SKETCHES), "sketches")
    known = sketches.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    first = known.groupBy("set_id").agg(F.min(F.struct("doc_id", "row", "n_shingles", "bands")).alias("r"), F.count("*").alias("copies"))
    nodes = staged(first.select("set_id", F.col("r.row").alias("node"), "r.doc_id", F.col("r.n_shingles").alias("n"), "r.bands", "copies"), "nodes")
    any_set = F.coalesce("set_id", F.lit(b""))
    odd = staged(sketches.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(any_set).alias("lo"), F.max(any_set).alias("hi")).where("lo <> hi").select("doc_id"), "odd")
    of_odd = known.join(odd, "doc_id", "left_semi").select("doc_id", "set_id").distinct().join(nodes.select("set_id", "node"), "set_id")
    twins = of_odd.join(of_odd.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")

    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band", "members")
    members = staged(banded.join(buckets, "band").select("band", "members", "node", "n"), "members")
    weights = members.groupBy("node").agg(F.sum("members").alias("weight"))
    weighted = members.join(weights, "node")
    centres = weighted.groupBy("band").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    stars = staged(members.join(centres, "band").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    wanted = nodes.join(weights.select("node"), "node", "left_semi").select("node", "doc_id", "set_id")
    texts = staged(_texts(docs, wanted, odd, width), "texts")
    links = staged(_verified(stars, texts, width, percent).unionByName(twins), "links")
    first = staged(components(links), "components")
    labelled = members.join(first, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    open_ = staged(labelled.join(mixed, "band", "left_semi"), "open")
    # How much of each open document some other open document has, too.
    shared = staged(
        texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_shingler(width), "node long, shingle long")
        .groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone")),
        "alone",
    )
    bounded = open_.join(shared, "node", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    # A partner of size m shares at most ``most``: 100 * most >= percent * (n + m - most).
    bounded = staged(bounded.withColumn("reach", F.floor(100 * F.col("most") / percent) - F.col("n") + F.col("most")).where(F.col("reach") >= F.col("n") * percent / 100), "bounded")
    smallest = bounded.groupBy("band").agg(F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = staged(bounded.join(smallest.where("lo <> hi").select("band", "least"), "band").where("reach >= least").drop("least"), "left")
    more = _between_components(left, nodes, texts, width, percent)
    found = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    for done in (members, stars, texts, links, open_, shared, bounded, left):
        discard(done)
    # Only classes with several rows or a link can have another component than their doc_id.
    lowest = nodes.select("set_id", "node", "doc_id", "copies").join(found, "node", "left").where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    by_set = lowest.join(lowest.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("set_id", "component_id")
    out = sketches.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if not odd.isEmpty():  # a doc_id's rows without words, too, are in the component of its others
        by_doc = out.join(odd, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(by_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w[1:3] AS k FROM d WHERE len(w) BETWEEN 1 AND 2
      UNION SELECT doc_id, list_slice(w, i, i + 2) FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
