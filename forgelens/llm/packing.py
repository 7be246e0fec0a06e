"""Packing documents into sequences: best-fit decreasing, certified by lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_slice, staged
from .tokens import encoder, vocabulary

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", part long, sequence_id long, offset long, bins long, bound long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"]


def _cutter(text: str, kind: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = encoder(text, kind, end), TaskContext.get().partitionId() << 40
        for batch in per_slice(batches, 2000):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            stream, lengths = code(batch.column("text"))
            ends = np.cumsum(lengths)
            for doc_id, begin, stop_at in zip(batch.column("doc_id").to_pylist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                ids = stream[begin:stop_at]
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for column, value in zip(out, (row, doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())), strict=True):
                        column.append(value)
                    row += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins. The largest bound over the dual-feasible functions that,
    for k = 0..capacity/2, count a size above capacity - k as a whole bin, one below k as
    nothing and all others as they are (sizes above half never share a bin)."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    below = lambda sums, x: np.where(x > 0, sums[np.maximum(x - 1, 0)], 0)
    whole = count[-1] - count[capacity - k]
    large, large_sum = count[capacity - k] - count[half], total[capacity - k] - total[half]
    small_sum = total[half] - below(total, k)
    free = large * capacity - large_sum
    return int(max(np.max(whole + large + np.maximum(0, -(-(small_sum - free) // capacity))), -(-int(total[-1]) // capacity)))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins), best fit, decreasing. Bins stand by what is free in
    them, and a bit mask of the free sizes in use finds the tightest."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, made


def _packer(capacity: int, round_no: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")  # the same result whatever order the rows came in
        sizes = table.column("length").to_numpy()
        bins, offsets, made = best_fit(sizes, capacity)
        part = table.column("part").to_numpy()
        n = len(sizes)
        named = {
            "sequence_id": (np.int64(round_no) << np.int64(58)) | (part << np.int64(28)) | bins,
            "offset": offsets, "bins": np.full(n, made), "bound": np.full(n, lower_bound(sizes, capacity)),
        }
        for name, values in named.items():
            table = table.append_column(name, pa.array(values.astype(np.int64)))
        return table

    return run


def pack(pieces: DataFrame, capacity: int, per_part: int = 20_000, rounds: int = 2) -> DataFrame:
    """Packs ``pieces`` (row unique, length 1..capacity; see PIECES) into sequences.

    Full pieces are sequences by themselves. The others are dealt at random into parts of
    about ``per_part``, which grow in number with the input, never in size. Each part is
    packed best-fit decreasing, and certified if its bins meet its lower bound. The parts
    with a gap exchange their pieces (a new random deal among them all) and are packed
    again, for at most ``rounds`` rounds; a round counts only if it saves bins. Adds
    sequence_id and offset, and the certificate: how many bins the piece's part has, and how
    many any packing of that part needs. An empty table gives an empty one. ``pieces`` must be a
    written table: it is read more than once.
    """
    full = F.col("length") == capacity
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    whole = pieces.where(full).select("*", (-1 - F.col("row")).alias("sequence_id"), zero.alias("offset"), one.alias("bins"), one.alias("bound"))
    rest = pieces.where(~full)
    out = [whole]
    for round_no in range(rounds + 1):
        parts = max(1, -(-rest.count() // per_part))
        dealt = rest.select(*pieces.columns, F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts)).alias("part"))
        packed = staged(dealt.groupBy("part").applyInArrow(_packer(capacity, round_no), PACKED), f"packed{round_no}")
        if round_no:
            made = packed.select("sequence_id").distinct().count()
            if made >= before:
                out.append(kept)
                break
        gap = F.col("bins") > F.col("bound")
        by_part = packed.where(gap).groupBy("part").agg(F.first("bins").alias("bins"))
        open_parts, before = by_part.agg(F.count("*"), F.coalesce(F.sum("bins"), F.lit(0))).first()
        if open_parts < 2 or round_no == rounds:
            out.append(packed)
            break
        out.append(packed.where(~gap))
        kept = rest = packed.where(gap)
    columns = [*pieces.columns, "sequence_id", "offset", "bins", "bound"]
    result = out[0].select(columns)
    for more in out[1:]:
        result = result.unionByName(more.select(columns))
    return result


def pack_documents(docs: DataFrame, vocabulary_path: str, kind: str = "bytes", end: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins and bound (see
    ``pack``) for each piece of each row of ``docs(doc_id, text)``.

    Null text: empty, so one piece with the end id alone. Null doc_ids are kept. Rows that
    share a doc_id are packed each by itself. Other columns are ignored.
    """
    cut = docs.select("doc_id", "text").mapInArrow(_cutter(vocabulary(vocabulary_path), kind, end, capacity), PIECES)
    return pack(staged(cut, "pieces"), capacity).select(COLUMNS)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
