"""Substring dedup: repeated windows of words, found level by level at doubling lengths."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, discard, mix, per_slice, staged, staged_path, word_hashes

LAST = (1 << 63) - 1  # stands for a null doc_id, which is after all others
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
SENT = "kind int, bucket int, doc_id long, h binary, g binary, d binary, n_words long, sha string, packed binary"
FOUND = "doc_id long, h binary, g binary"
#: Bits of the first hash that tell windows apart within a bucket. The last level has a
#: second hash of 64 bits beside them.
LOW = 36
#: Bytes of text for which there is one bucket of hashes and one part of the documents, and
#: the least number of bits in their number.
PER_BUCKET, LEAST_BITS = 16 << 20, 4
#: Bytes of text for which the table of packed texts has one file.
PER_FILE = 16 << 20


def levels(window: int, least: int = 4) -> list[int]:
    """``least``, then each twice the one before, up to ``window``."""
    out = [min(least, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def window_hashes(h: np.ndarray, length: int, odd: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` word hashes."""
    n = len(h) - length + 1
    acc = np.full(max(0, n), np.uint64(length), np.uint64)
    for j in range(length if n > 0 else 0):
        acc = mix(acc * _ODD[odd] + h[j : j + n])
    return acc


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, done = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    out = values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _flag(h: np.ndarray, g: np.ndarray, d: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted h, g, d, then which of them count as repeated, and which stand first of their
    hash. At the last level a window counts if a smaller document has it; before, if any
    other has it."""
    order = np.lexsort((d, g, h)) if last else np.lexsort((d, h))
    h, g, d = h[order], g[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    if last:
        return h, g, d, d > d[start][group], new
    high = np.maximum.reduceat(d, start) if len(d) else d
    return h, g, d, (high > d[start])[group] if len(d) else new, new


def _packed(x: np.ndarray) -> bytes:
    """Ascending or not, unsigned 64-bit numbers by their distance to the least, or to the
    one before if they ascend, in as few bytes as the largest needs."""
    ascending = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
    least = x.min()
    rest = np.diff(x, prepend=x[:1]) if ascending else x - least
    most = int(rest.max())
    kind = 0 if most < 1 << 16 else 1 if most < 1 << 32 else 2
    return bytes([kind | 4 * ascending]) + np.array([least], "<u8").tobytes() + rest.astype(("<u2", "<u4", "<u8")[kind]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    rest = np.frombuffer(blob, ("<u2", "<u4", "<u8")[blob[0] & 3], offset=9).astype(np.uint64)
    return (np.cumsum(rest, dtype=np.uint64) if blob[0] & 4 else rest) + np.frombuffer(blob, "<u8", 1, 1)[0]


def _by_part(h: np.ndarray, g: np.ndarray, d: np.ndarray, parts: int, last: bool) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """part, h, g, d: what concerns the documents of each part, a part by the document's hash."""
    part = (mix(d.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    h, g, d, part = h[order], g[order], d[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)], strict=True):
        if b > a:
            yield int(part[a]), h[a:b].tobytes(), g[a:b].tobytes() if last else b"", _packed(d[a:b].astype(np.uint64))


def _send(h: np.ndarray, g: np.ndarray, d: np.ndarray, parts: int, last: bool) -> pa.RecordBatch:
    """What a slice of documents tells: documents it knows to repeat a window (kind 1), and
    for each of its windows once, by bucket of the hash, the first document (kind 0). A
    window that all documents share is told once a slice, not once a document."""
    h, g, d, repeated, new = _flag(h, g, d, last)
    rows: list[tuple] = [(1, part, None, hs, gs, ds, None, None, None) for part, hs, gs, ds in _by_part(h[repeated], g[repeated], d[repeated], parts, last)]
    h, g, d = h[new], g[new], d[new]
    bucket = (h >> np.uint64(LOW)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
        if b > a:
            rows.append((0, int(bucket[a]), None, _packed(h[a:b]), g[a:b].tobytes() if last else b"", _packed(d[a:b].astype(np.uint64)), None, None, None))
    return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["kind", "bucket", "doc_id", "h", "g", "d", "n_words", "sha", "packed"])


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The hash's top bits: its bucket, and LOW bits within it."""
    return h >> np.uint64(64 - LOW - bits)


class _Windows:
    """The windows that a slice of documents sends at one level. Of a window's sub-windows
    of the level's length, the one with the least hash is its anchor: equal windows have
    equal anchors, so anchors are sent. At the last level a window is its own anchor."""

    def __init__(self, length: int, window: int, bits: int, parts: int):
        self.length, self.window, self.bits, self.parts, self.last = length, window, bits, parts, length == window
        self.h: list[np.ndarray] = []
        self.g: list[np.ndarray] = []
        self.d: list[np.ndarray] = []

    def add(self, doc: int, words: np.ndarray, at: np.ndarray | None = None) -> None:
        """The windows of a document, or those that start at ``at``."""
        h = least_of(_short(window_hashes(words, self.length), self.bits), self.window - self.length + 1)
        g = window_hashes(words, self.length, 1) if self.last else np.zeros(len(h), np.uint64)
        if at is not None:
            h, g = h[at], g[at]
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.h.append(h[new])
        self.g.append(g[new])
        self.d.append(np.full(int(new.sum()), doc))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.h:
            yield _send(np.concatenate(self.h), np.concatenate(self.g), np.concatenate(self.d), self.parts, self.last)


def _first_level(length: int, window: int, bits: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, press = word_hashes(), zstandard.ZstdCompressor(3)
        for batch in per_slice(batches):
            out, rows = _Windows(length, window, bits, parts), []
            for doc, text in zip(batch.column("doc_id").to_numpy().tolist(), binary(batch.column("text")), strict=True):
                words = (text or b"").split()
                joined = b" ".join(words)
                rows.append((2, None, doc, None, None, None, len(words), hashlib.sha256(joined).hexdigest(), press.compress(joined)))
                if len(words) >= window:
                    out.add(doc, hashes.of(words))
            yield _batch(rows)
            yield from out.batches()

    return run


def _told(blobs: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in blobs if x), "<u8")


def _next_level(before: int, length: int, window: int, bits: int, parts: int):
    """Windows whose anchor at the level before was repeated, extended to this level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, press = word_hashes(), zstandard.ZstdDecompressor()
        for batch in per_slice(batches, size=2 << 20):
            out = _Windows(length, window, bits, parts)
            for doc, packed, known in zip(batch.column("doc_id").to_numpy().tolist(), batch.column("packed").to_pylist(), batch.column("h").to_pylist(), strict=True):
                words = hashes.of(press.decompress(packed).split())
                if len(words) < window:  # another row of this doc_id was found
                    continue
                anchors = least_of(_short(window_hashes(words, before), bits), window - before + 1)
                at = np.flatnonzero(np.isin(anchors, _told([known])))
                if len(at):
                    out.add(doc, words, at)
            yield from out.batches()

    return run


def _read(table: pa.Table, last: bool) -> tuple[np.ndarray, np.ndarray]:
    d = np.concatenate([_unpacked(x) for x in table.column("d").to_pylist()]).astype(np.int64)
    return d, _told(table.column("g").to_pylist()) if last else np.zeros(len(d), np.uint64)


def _meet(parts: int, last: bool):
    """One bucket of hashes: which documents repeat which windows, a row a part of them."""

    def run(table: pa.Table) -> pa.Table:
        d, g = _read(table, last)
        h = np.concatenate([_unpacked(x) for x in table.column("h").to_pylist()])
        h, g, d, repeated, _ = _flag(h, g, d, last)
        rows = list(_by_part(h[repeated], g[repeated], d[repeated], parts, last))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("bucket", "h", "g", "d"), columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    return run


def _collect(last: bool):
    """One part of the documents: a row a document with all its repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        d, g = _read(table, last)
        h = _told(table.column("h").to_pylist())
        order = np.argsort(d, kind="stable")
        h, g, d = h[order], g[order], d[order]
        cuts = np.flatnonzero(np.diff(d)) + 1
        spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)], strict=True))
        return pa.table({"doc_id": pa.array(d[[a for a, _ in spans]]), "h": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), "g": pa.array([g[a:b].tobytes() if last else b"" for a, b in spans], pa.binary())})

    return run


def _hits(words: np.ndarray, known: np.ndarray, second: np.ndarray, window: int, bits: int) -> np.ndarray:
    """Which windows have a pair of hashes that is known. Pairs that share the first hash
    stand side by side and are looked through."""
    h, g = _short(window_hashes(words, window), bits), window_hashes(words, window, 1)
    order = np.lexsort((second, known))
    known, second = known[order], second[order]
    low, high = np.searchsorted(known, h), np.searchsorted(known, h, "right")
    hit = np.zeros(len(h), bool)
    for k in range(int((high - low).max(initial=0))):
        more = low + k < high
        hit[more] |= second[low[more] + k] == g[more]
    return hit


def _remover(window: int, bits: int):
    """For rows with repeated windows: how many words go, the sha of the rest, the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, press = word_hashes(), zstandard.ZstdDecompressor()
        for batch in per_slice(batches, 1000, 2 << 20):
            out: tuple[list, ...] = ([], [], [])
            for sha, packed, known, second in zip(*(batch.column(c).to_pylist() for c in ("sha", "packed", "h", "g")), strict=True):
                if packed is None:
                    row = (0, sha, None)
                else:
                    words = press.decompress(packed).split()
                    at = np.flatnonzero(_hits(hashes.of(words), _told([known]), _told([second]), window, bits))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    kept = [x for x, k in zip(words, (np.cumsum(edge)[:-1] == 0).tolist(), strict=True) if k]
                    rest = b" ".join(kept)
                    row = (len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _repeats(sent: DataFrame, parts: int, last: bool) -> DataFrame:
    """doc_id with its repeated windows. Hashes meet by bucket; what is found goes back by
    part of the documents, so that rows are parts of buckets, not documents of buckets."""
    met = sent.where("kind = 0").select("bucket", "h", "g", "d").groupBy("bucket").applyInArrow(_meet(parts, last), "bucket int, h binary, g binary, d binary")
    both = met.unionByName(sent.where("kind = 1").select("bucket", "h", "g", "d"))
    return both.groupBy("bucket").applyInArrow(_collect(last), FOUND)


@contextmanager
def _bucketed(df: DataFrame, files: int) -> Iterator[DataFrame]:
    """``df`` as a table bucketed by doc_id in the shared folder: its rows move once, and then
    joins by doc_id move only the other side. Catalog entry and files go at the end."""
    spark, name = df.sparkSession, f"forgelens_{uuid.uuid4().hex}"
    df.repartition(files, "doc_id").write.bucketBy(files, "doc_id").option("path", staged_path(spark, name)).saveAsTable(name)
    table = spark.table(name)
    try:
        yield table
    finally:
        discard(table)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _without(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows that are no copies. Hashes of texts are compared by order, not as a key of the
    join, so that the key is doc_id alone, by which ``texts`` lies in buckets."""
    t, c = texts.alias("t"), copies.select("doc_id", "sha").alias("c").hint("shuffle_hash")
    return t.join(c, (F.col("t.doc_id") == F.col("c.doc_id")) & (F.col("t.sha") <= F.col("c.sha")) & (F.col("t.sha") >= F.col("c.sha")), "left_anti")


def repeated_words(docs: DataFrame, window: int = 13, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text for each row of
    ``docs(doc_id, text)``: the words that stay, joined by one space.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence
    also starts in a document with a smaller doc_id. Windows are judged on the input.
    Null text: no words. A null doc_id is after all others (and stands at 2^63 - 1, which no
    document may have). Rows that share a doc_id do not count for each other. Texts shorter
    than the window lose nothing. Other columns are ignored; an empty table gives an empty one.

    Level-wise: windows repeated at one length alone are extended to twice that length, or
    to the window's own, until no candidate is left. A level sends anchors, at the first one
    about a sixth of the windows; each slice of documents first settles what its own
    documents share, so a passage that many share is sent once a slice. Copies of a smaller
    document lose all their words and are not extended. The last level compares two hashes
    of a window, of 100 bits or more. Buckets of hashes grow in number with the input, not
    in size.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    spark, lengths = docs.sparkSession, levels(window)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(64 - LOW, max(LEAST_BITS, (-(-size // PER_BUCKET) - 1).bit_length()))
    parts = 1 << bits
    sent = staged(docs.mapInArrow(_first_level(lengths[0], window, bits, parts), SENT), "level0", ["kind"])
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_FILE))
    with _bucketed(sent.where("kind = 2").select("doc_id", "n_words", "sha", "packed"), files) as packed:
        found = staged(_repeats(sent, parts, len(lengths) == 1), "repeats0")
        # The first document of each text, from an aggregate; all others of it are copies. They
        # meet by doc_id, so a text of many copies is in no task as a whole.
        long = packed.where(F.col("n_words") >= window).select("doc_id", "sha")
        copies = staged(_without(long, long.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))).distinct(), "copies")
        discard(sent)
        rest = _without(packed, copies)
        for before, length in zip(lengths, lengths[1:], strict=False):
            if found.isEmpty():
                break
            extend = _next_level(before, length, window, bits, parts)
            sent = staged(rest.join(found.hint("shuffle_hash"), "doc_id").select("doc_id", "packed", "h").mapInArrow(extend, SENT), f"level{length}", ["kind"])
            last, found = found, staged(_repeats(sent, parts, length == window), f"repeats{length}")
            discard(sent)
            discard(last)
        marked = rest.join(found.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "n_words", "sha", F.when(F.col("h").isNotNull() | F.lit(texts), F.col("packed")).alias("packed"), "h", "g")
        cut = marked.mapInArrow(_remover(window, bits), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
        c, p = copies.alias("c"), packed.alias("p")
        whole = p.join(c.hint("shuffle_hash"), (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.sha") <= F.col("c.sha")) & (F.col("p.sha") >= F.col("c.sha")), "left_semi")
        whole = whole.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
        out = cut.unionByName(whole).withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))
        result = staged(out.select("doc_id", "n_words", "n_removed", "kept_sha256", *([F.col("kept").cast("string").alias("kept_text")] if texts else [])), "passages")
        discard(found)
        discard(copies)
    return result


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, (SELECT unnest(range(0, 13)) AS j)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
