"""Token-ID output in a word-aligned Simple-8b file format.

The file format. A shard is a Parquet folder, so its commit survives lost executors; each
row is one segment of documents in ascending order:

- ``part``, ``seq``: place of the segment; (part, seq) ascends with doc_id.
- ``doc_ids``, ``lengths``: for each document its id and its number of token ids.
- ``n_ids``, ``n_words``: sums over the segment.
- ``offsets``: little-endian u32 per block of 1024 ids: its first 64-bit word.
- ``words``: little-endian u64. The top 4 bits select a layout, the other 60 hold the ids,
  the first in the lowest bits.

Layouts 1..14 hold COUNTS[s] ids of WIDTHS[s] bits. Layout 0 is the escape: one id of 32
bits, for ids that need more than 30. Blocks decode independently of each other: all words
of a layout are decoded at once, for any set of blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_slice, staged
from .tokens import encoder, vocabulary

BLOCK = 1024
#: ids per word and bits per id by layout; layout 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([32, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 30], np.int64)

#: Bits that a small id needs.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
SEGMENTS = "part int, seq int, doc_ids array<long>, lengths array<long>, n_ids long, n_words long, offsets binary, words binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 32-bit ids. Greedy: each word takes
    as many of the next ids as a layout can hold. An empty array has no words."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    padded = np.zeros((blocks, BLOCK + 64), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = ids
    padded[:, :BLOCK] = full.reshape(blocks, BLOCK)
    need = np.zeros(padded.shape, np.uint8)
    bits = np.zeros(blocks * BLOCK, np.uint8)
    bits[:n] = _BITS.take(ids) if ids.max() < len(_BITS) else np.frexp(ids.astype(np.float64))[1]
    need[:, :BLOCK] = bits.reshape(blocks, BLOCK)
    most = {1: need}  # most[c][:, i]: bits that the ids i..i+c-1 need
    size = 1
    while size < 64:
        wide = most[size].copy()
        wide[:, :-size] = np.maximum(most[size][:, :-size], most[size][:, size:])
        most[2 * size], size = wide, 2 * size
    layout = np.zeros(padded.shape, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        wide = most[p]
        if p != c:
            wide = wide.copy()
            wide[:, : -(c - p)] = np.maximum(most[p][:, : -(c - p)], most[p][:, c - p :])
        np.copyto(layout, np.uint8(s), where=wide <= np.uint8(WIDTHS[s]))
    # All blocks walk at once; the walk takes as many steps as the longest block has words.
    ends = np.full(blocks, BLOCK, np.int64)
    ends[-1] = n - (blocks - 1) * BLOCK
    at, live, rows, places = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(live):
        rows.append(live)
        places.append(at[live])
        at[live] += COUNTS[layout[live, at[live]]]
        live = live[at[live] < ends[live]]
    row, place = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(row.astype(np.uint16) if blocks < 1 << 16 else row, kind="stable")  # places ascend already
    row, place = row[order], place[order]
    kind = layout[row, place]
    words = kind.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kind):
        hit = np.flatnonzero(kind == s)
        for j in range(int(COUNTS[s])):
            words[hit] |= padded[row[hit], place[hit] + j] << np.uint64(j * int(WIDTHS[s]))
    return words.astype("<u8"), np.searchsorted(row, np.arange(blocks)).astype("<u4")


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids that ``encode`` was given."""
    out = np.zeros(n, "<u4")
    if not n:
        return out
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[kind]
    block = np.zeros(len(words), np.int64)
    block[offsets[1:].astype(np.int64)] = 1
    block = np.cumsum(block)
    before = np.cumsum(count) - count
    place = before - before[offsets.astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(kind):
        hit, mask = np.flatnonzero(kind == s), np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            to = place[hit] + j
            keep = to < end[hit]
            out[to[keep]] = (words[hit[keep]] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out


def _writer(text: str, kind: str, end: int, per_segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = encoder(text, kind, end), TaskContext.get().partitionId(), 0
        for batch in per_slice(batches, per_segment):
            stream, lengths = code(batch.column("text"))
            words, offsets = encode(stream)
            row = [part, seq, batch.column("doc_id").to_pylist(), lengths.tolist(), len(stream), len(words), offsets.tobytes(), words.tobytes()]
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "seq", "doc_ids", "lengths", "n_ids", "n_words", "offsets", "words"])

    return run


def write_token_files(docs: DataFrame, path: str | None, vocabulary_path: str, kind: str, end: int, partitions: int, per_segment: int = 2000) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes the segments below ``path`` (None: the
    shared folder) in ascending doc_id order. Returns the segments as read back.

    Null text: empty. Null doc_id sorts first. Rows that share a doc_id stay side by side,
    ordered by text. Other columns are ignored. An empty table has no segments.
    Only doc_id and text travel, once; the range exchange reads doc_id from the files first.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    segments = ordered.mapInArrow(_writer(vocabulary(vocabulary_path), kind, end, per_segment), SEGMENTS)
    if path is None:
        return staged(segments, "token_files")
    segments.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["offsets"], "<u4"), row["n_ids"])
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])


def token_index(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in token files, decoded.

    ``start`` sums whole segments: one row a part, then one a segment within its part; no
    exchange moves ids."""
    digest = segments.mapInArrow(_digest, "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    by_part = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    to_part = by_part.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("part_start"))
    in_part = segments.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("seq_start"))
    starts = in_part.join(to_part, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("segment_start"))
    return digest.join(starts, ["part", "seq"]).select("doc_id", (F.col("segment_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the input's files that a shard holds, at most about.
PER_SHARD = 256 << 20


def shards_for(docs: DataFrame) -> int:
    """Shards grow in number with the input, not in size. The files' bytes are what the plan
    says of its scan, without a job; where it does not know, it says a number beyond all."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * partitions_for(docs.sparkSession), -(-size // PER_SHARD) if size < 1 << 60 else 0)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    segments = write_token_files(docs, None, public_tokenizers.path("word_bpe_49k.json"), "words", 1, shards_for(docs))
    return token_index(segments)
