"""A maintained index of trigrams: postings with places, added to and taken from by changes.

A posting says where a trigram stands in one column of one text. A phrase stands where its
trigrams do, side by side; so matches and term frequencies come from the postings of the
asked trigrams alone, and no text is read again. Postings lie in folders by a hash of the
trigram, sorted by it, so that a query reads the row groups of its trigrams. A row of them has
one trigram of a block of texts: their ids and lengths, where each one's places end, and the
places, so that a build moves a row for a block's trigram and not for each text's.

A change adds a generation of postings and a list of the ids whose older postings no longer
hold; both count from the moment the log has the entry of that generation. The entry also
has the numbers of texts and of trigrams, from which the scores' averages come.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import any_of
from ..sources.tables import Log
from .retrieval import B, GRAM, K1, LEAST_IDF, compile_query

#: Folders of postings. A generation of many more trigrams than one task holds should have more.
BUCKETS = 64
#: Up to this many ids of changed texts, they are sent to all tasks.
FEW_IDS = 1_000_000
#: Bytes of text in a block; a longer text is one of its own.
BLOCK = 4 << 20


def length_of(columns: Sequence[str]) -> Column:
    """A text's number of trigrams, over all columns."""
    size = lambda c: F.greatest(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) - (GRAM - 1), F.lit(0))
    return reduce(lambda a, b: a + b, [size(c) for c in columns])


def _cut(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The batch as blocks."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        yield batch.slice(at, to - at)
        at = to


def _block(ids: pa.Array, sizes: pa.Array, texts: pa.Array, place: int) -> pa.RecordBatch | None:
    """The postings of one column of a block. Places are sorted by trigram and then as they
    stand, in one go over all texts."""
    known = [t or "" for t in texts.to_pylist()]
    n = np.fromiter(map(len, known), np.int64, len(known))
    points = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32)
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(known), dtype=np.int32), n)
    at = (np.arange(points.size) - np.repeat(start, n)).astype(np.int32)
    begins = np.flatnonzero(at < np.repeat(n, n) - (GRAM - 1))
    if not begins.size:
        return None
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    letters = np.flatnonzero(seen).astype(np.uint32)
    letter = np.cumsum(seen)[points] - 1
    wide, low = int(letters.size - 1).bit_length(), int(points.size).bit_length()
    code = letter[begins] << 2 * wide | letter[begins + 1] << wide | letter[begins + 2]
    few = None
    if GRAM * wide + low > 62:  # many letters: trigrams by number
        few, code = np.unique(code, return_inverse=True)
    key = code << low | begins
    key.sort()
    code, where = key >> low, key & ((1 << low) - 1)
    of, at = owner[where], at[where]
    new_gram = np.concatenate(([True], code[1:] != code[:-1]))
    first = np.flatnonzero(new_gram | np.concatenate(([True], of[1:] != of[:-1])))  # of each posting
    gram_first = np.flatnonzero(new_gram)
    rows = np.searchsorted(first, gram_first)  # the first posting of each trigram
    ends = np.append(first[1:], at.size) - np.repeat(gram_first, np.diff(np.append(rows, first.size)))
    code = code[gram_first] if few is None else few[code[gram_first]]
    parts = np.stack([code >> 2 * wide, code >> wide & ((1 << wide) - 1), code & ((1 << wide) - 1)], axis=1)
    joined = letters[parts].astype("<u4").tobytes().decode("utf-32-le")
    offsets, who = pa.array(np.append(rows, first.size).astype(np.int32)), pa.array(of[first])
    listed = lambda values, by=offsets: pa.ListArray.from_arrays(by, values)
    arrays = [
        pa.array([joined[i : i + GRAM] for i in range(0, len(joined), GRAM)]), pa.array(np.full(gram_first.size, place, np.int32)), listed(ids.take(who)), listed(sizes.take(who)),
        listed(pa.array(ends.astype(np.int32))), listed(pa.array(at), pa.array(np.append(gram_first, at.size).astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["gram", "place", "ids", "lengths", "ends", "at"])


def _stored(kind: str) -> str:
    return f"gram string, place int, ids array<{kind}>, lengths array<int>, ends array<int>, at array<int>"


def blocks(texts: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """gram, place, ids, lengths, ends, at: the trigrams of blocks of texts. The texts are
    dealt by id, once; their postings are not dealt again."""
    names = [f"t{i}" for i in range(len(columns))]
    rows = texts.select(F.col(key).alias("id"), *[c for c in dict.fromkeys(columns) if c != key and c != "id"]).repartition("id")
    low = rows.select("id", length_of(columns).cast("int").alias("length"), *[F.lower(F.col(c).cast("string")).alias(t) for c, t in zip(columns, names, strict=True)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _cut(batch, names):
                for place, t in enumerate(names):
                    if (out := _block(block["id"], block["length"], block[t], place)) is not None:
                        yield out

    return low.mapInArrow(made, _stored(texts.schema[key].dataType.simpleString()))


def per_text(stored: DataFrame) -> DataFrame:
    """gram, id, place, length, at of blocks."""
    own = lambda i: F.slice("at", F.coalesce(F.get("ends", i - 1), F.lit(0)) + 1, F.get("ends", i) - F.coalesce(F.get("ends", i - 1), F.lit(0)))
    each = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.get("lengths", i).alias("length"), own(i).alias("at")))
    return stored.select("gram", "place", F.explode(each).alias("x")).select("gram", "x.id", "place", "x.length", "x.at")


def postings(texts: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """gram, id, place, length, at: for each trigram (lower-cased) of each column of each text,
    the column's number, the text's number of trigrams over all columns, and where in the
    column the trigram begins, in order. Null and short columns have none. Ids are unique."""
    return per_text(blocks(texts, columns, key))


def lengths(texts: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """id, length of each text, those without trigrams included."""
    return texts.select(F.col(key).alias("id"), length_of(columns).alias("length"))


def _bucket(gram: Column, n: int) -> Column:
    return (F.crc32(gram.cast("binary")) % n).cast("int")


class Index:
    """The index of one table's texts below a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/_log")

    def entry(self) -> dict | None:
        n = self.log.last()
        return self.log.read(n) if n else None

    @classmethod
    def create(cls, texts: DataFrame, path: str, columns: Sequence[str], key: str = "id", buckets: int = BUCKETS) -> Index:
        """Indexes all of ``texts``. Where the folder has an index already, it is that one."""
        index = cls(texts.sparkSession, path)
        if index.entry() is None:
            index._generation({"columns": list(columns), "key": key, "buckets": buckets, "type": texts.schema[key].dataType.simpleString(), "generations": [], "n": 0, "length": 0}, 0, texts, None)
        return index

    def sync(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Takes the postings of the ids in ``changed`` and ``removed`` away, and adds those
        of the texts in ``changed``: as after a rebuild over the changed table. An id that is
        not indexed is added; a removed one that is not is nothing. Another change that
        commits first is an error, and nothing of this one counts."""
        n = self.log.last()
        entry, key = self.log.read(n), self.log.read(n)["key"]
        ids = [df.select(F.col(key if key in df.columns else df.columns[0]).alias("id")) for df in (changed, removed) if df is not None]
        self._generation(entry, n, changed, reduce(DataFrame.unionByName, ids).where("id IS NOT NULL").distinct() if ids else None)

    def _generation(self, entry: dict, n: int, texts: DataFrame | None, gone: DataFrame | None) -> None:
        name = f"{len(entry['generations']):06d}-{uuid.uuid4().hex}"
        folder = f"{self.path}/{name}"
        stats, old = {"n": 0, "length": 0}, {"n": 0, "length": 0}
        if gone is not None:
            gone.write.parquet(f"{folder}/gone")
            if entry["generations"]:
                met = self._lengths(entry).join(self._sent(self.spark.read.parquet(f"{folder}/gone")), "id", "left_semi")
                old = met.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first().asDict()
        if texts is not None:
            lengths(texts, entry["columns"], entry["key"]).write.parquet(f"{folder}/lengths")
            stats = self.spark.read.parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first().asDict()
            self._write(blocks(texts, entry["columns"], entry["key"]), entry, folder)
        made = entry | {"generations": [*entry["generations"], {"folder": name, "gone": gone is not None, "texts": texts is not None}], **{k: entry[k] + stats[k] - old[k] for k in ("n", "length")}}
        if not self.log.append(n + 1, made):
            raise RuntimeError("another change of the index came first")

    def _write(self, rows: DataFrame, entry: dict, folder: str) -> None:
        by = rows.withColumn("bucket", _bucket(F.col("gram"), entry["buckets"])).sortWithinPartitions("bucket", "gram")
        by.write.option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{folder}/postings")

    def _sent(self, ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= FEW_IDS else ids

    def _union(self, entry: dict, read) -> DataFrame:
        """What ``read`` gives of each generation, without ids that a later one took away."""
        out, later = None, None
        for g in reversed(entry["generations"]):
            if g["texts"]:
                rows = read(f"{self.path}/{g['folder']}")
                rows = rows if later is None else rows.join(self._sent(later), "id", "left_anti")
                out = rows if out is None else out.unionByName(rows)
            if g["gone"]:
                ids = self.spark.read.parquet(f"{self.path}/{g['folder']}/gone")
                later = ids if later is None else later.unionByName(ids).distinct()
        return out

    def _lengths(self, entry: dict) -> DataFrame:
        return self._union(entry, lambda folder: self.spark.read.schema(f"id {entry['type']}, length int").parquet(f"{folder}/lengths"))

    def postings(self, wanted: Sequence[str]) -> DataFrame:
        """gram, id, place, length, at of these trigrams: their folders and row groups alone."""
        entry = self.entry()
        buckets = sorted({zlib.crc32(g.encode()) % entry["buckets"] for g in wanted})

        def of(folder: str) -> DataFrame:
            path = self.log.jvm.org.apache.hadoop.fs.Path
            there = [f for b in buckets if self.log.fs.exists(path(f := f"{folder}/postings/bucket={b}"))]
            rows = self.spark.read.schema(_stored(entry["type"])).parquet(*there) if there else self.spark.createDataFrame([], _stored(entry["type"]))
            return per_text(rows.where(F.col("gram").isin(list(wanted))))

        return self._union(entry, of)

    def texts(self) -> int:
        """How many texts are indexed."""
        return self.entry()["n"]

    def match(self, text: str) -> DataFrame:
        """id, bm25, relevance of the texts that match all groups of a query, as a scan of the
        texts would score them. A query that is too short for trigrams matches nothing here.

        Frequencies count a phrase's places without overlaps, each within one column; how many
        texts hold a phrase is counted over its postings, in the same plan."""
        entry, groups = self.entry(), compile_query(text)
        flat = list(dict.fromkeys(p.lower() for g in groups or [] for p in g))
        wanted = sorted({p[i : i + GRAM] for p in flat for i in range(len(p) - GRAM + 1)})
        if not wanted or not entry["n"]:
            return self.spark.createDataFrame([], f"id {entry['type']}, bm25 double, relevance double")
        at = lambda g: F.coalesce(F.first(F.when(F.col("gram") == g, F.col("at")), ignorenulls=True), F.array().cast("array<int>"))
        columns = self.postings(wanted).repartition("id").groupBy("id", "place", "length").agg(*[at(g).alias(f"g{i}") for i, g in enumerate(wanted)])
        per_column = columns.select("id", "length", *[_count(p, wanted).alias(f"tf{i}") for i, p in enumerate(flat)])
        per_text = per_column.groupBy("id", "length").agg(*[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(flat))]).where(any_of([F.col(f"tf{i}") > 0 for i in range(len(flat))]))
        found = per_text.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(flat))])
        places = {p: i for i, p in enumerate(flat)}
        hit = reduce(lambda a, b: a & b, [any_of([F.col(f"tf{places[p.lower()]}") > 0 for p in g]) for g in groups])
        n, average = entry["n"], entry["length"] / entry["n"] or 1.0
        score = F.lit(0.0)
        for i in range(len(flat)):
            tf, df = F.col(f"tf{i}"), F.col(f"n{i}")
            idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / average))
        scored = per_text.where(hit).join(F.broadcast(found)).select("id", score.alias("bm25"))  # one row is broadcast
        return scored.withColumn("relevance", 1 - 1 / (1 + F.abs(F.col("bm25"))))

    def top(self, text: str, k: int) -> DataFrame:
        return self.match(text).orderBy(F.col("bm25").desc(), "id").limit(k)

    def compact(self) -> None:
        """One generation of all that holds. Folders of older ones stay for readers that
        have begun; delete those that the newest entry does not name."""
        n = self.log.last()
        entry = self.log.read(n)
        name = f"{len(entry['generations']):06d}-{uuid.uuid4().hex}"
        self._lengths(entry).write.parquet(f"{self.path}/{name}/lengths")
        rows = self._union(entry, lambda folder: per_text(self.spark.read.schema(_stored(entry["type"])).parquet(f"{folder}/postings")))
        each = F.array_sort(F.collect_list(F.struct("id", "length", "at")))
        part = F.pmod(F.xxhash64("id"), F.lit(max(1, entry["length"] // BLOCK)))  # as many blocks as a build has
        listed = rows.groupBy("gram", "place", part.alias("part")).agg(each.alias("x"))
        ends = F.aggregate("x", F.array().cast("array<int>"), lambda a, v: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.size(v["at"])))
        self._write(listed.select("gram", "place", F.col("x.id").alias("ids"), F.col("x.length").alias("lengths"), ends.alias("ends"), F.flatten("x.at").alias("at")), entry, f"{self.path}/{name}")
        if not self.log.append(n + 1, entry | {"generations": [{"folder": name, "gone": False, "texts": True}]}):
            raise RuntimeError("another change of the index came first")


def _count(phrase: str, wanted: Sequence[str]) -> Column:
    """How often a phrase stands in a column, without overlaps, from its trigrams' places."""
    parts = [phrase[i : i + GRAM] for i in range(len(phrase) - GRAM + 1)]
    back = lambda places, by: F.transform(places, lambda x: x - by)
    shifted = [back(F.col(f"g{wanted.index(g)}"), i) for i, g in enumerate(parts)]
    both = F.array_sort(reduce(F.array_intersect, shifted))
    zero = F.struct(F.lit(-len(phrase)).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, x: F.when(x >= acc["last"] + len(phrase), F.struct(x.alias("last"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    return F.aggregate(both, zero, step, lambda acc: acc["n"])
