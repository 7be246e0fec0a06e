"""Periodic runs of words: suffix automaton, merged end positions, squares, runs.

A run is a stretch of words with smallest period q and a length of at least 24 words and
3 * q that no neighbouring word extends. In a document's suffix automaton, a state stands
for a longest sequence of words and its set of end positions. Sets are merged from children
to parents, the smaller into the larger; each insertion makes new neighbours. Two new
neighbours at a distance d of at most the state's length are the ends of two equal sequences
that overlap or touch: a square of period d, which begins where the sequence does. It cannot
begin earlier (the state is the deepest that holds both), so it is extended to the right alone.

The ends of the last two copies of a run's word sequence of length L - q are neighbours in the
state that first holds both: an occurrence between them would give the run a smaller period.
That state's length is L - q, so only squares of a length (state's length + d) of 24 and of
3 * d can be whole runs; the others are left alone.

Before that, words that no run can hold are cut away: in a run, each window of four words
stands again at a distance of q in the same run (see ``stretches``). What is left of a
document, usually nothing, goes through the automaton.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, mix, per_slice

#: A run's least length in words, and in periods.
LEAST, TIMES = 24, 3
#: Words of the windows that find what may be in a run.
WINDOW = 4
#: Positions in a bucket of an ordered set, at most twice as many.
BUCKET = 512


class Ends:
    """An ordered set of positions, in buckets, so that an insertion moves little."""

    __slots__ = ("buckets", "least", "size")

    def __init__(self, position: int):
        self.buckets, self.least, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for bucket in self.buckets:
            yield from bucket

    def add(self, x: int) -> tuple[int, int]:
        """Inserts ``x``, which is new; its neighbours below and above, -1 for none."""
        least, buckets = self.least, self.buckets
        b = bisect_left(least, x) - 1
        if b < 0:
            above, below = least[0], -1
            least[0] = x
            bucket = buckets[b := 0]
            bucket.insert(0, x)
        else:
            bucket = buckets[b]
            at = bisect_left(bucket, x)
            below = bucket[at - 1]
            above = bucket[at] if at < len(bucket) else least[b + 1] if b + 1 < len(least) else -1
            insort(bucket, x)
        self.size += 1
        if len(bucket) > 2 * BUCKET:
            rest = bucket[BUCKET:]
            del bucket[BUCKET:]
            buckets.insert(b + 1, rest)
            least.insert(b + 1, rest[0])
        return below, above


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) by state: the longest sequence of each, its longest suffix that
    ends at more places, and the place where a state was made, -1 for copies."""
    length, link, end, moves = [0], [-1], [-1], [{}]
    last = 0
    for place, w in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(place)
        moves.append({})
        at = last
        while at >= 0 and w not in moves[at]:
            moves[at][w] = new
            at = link[at]
        if at >= 0:
            to = moves[at][w]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                end.append(-1)
                moves.append(moves[to].copy())
                while at >= 0 and moves[at].get(w) == to:
                    moves[at][w] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return length, link, end


def smallest(block: list[int]) -> bool:
    """Whether a block is no repetition of a shorter one."""
    d, n, r = len(block), len(block), 2
    while n > 1:
        if r * r > n:
            r = n
        if n % r == 0:
            if block[: d - d // r] == block[d // r :]:
                return False
            while n % r == 0:
                n //= r
        r += 1
    return True


def runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, by start, then period."""
    length, link, end = automaton(words)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up, mine = link[state], sets[state]
        sets[state] = None
        if not up:
            continue
        theirs = sets[up]
        if theirs is None:
            sets[up] = mine
            continue
        if theirs.size < mine.size:
            mine, theirs = theirs, mine
        sets[up], size, before = theirs, length[up], -1
        for x in mine:
            below, above = theirs.add(x)
            # Those that came in just before were neighbours in the state below already.
            for p, q in ((below if below != before else -1, x), (x, above)):
                d = q - p
                if p >= 0 and q >= 0 and d <= size and size + d >= LEAST and size >= (TIMES - 1) * d:
                    start = p - size + 1
                    if (start, d) not in found:
                        to = q + 1
                        while to < n and words[to] == words[to - d]:
                            to += 1
                        found[start, d] = to - start
            before = x
    return sorted((s, k, d) for (s, d), k in found.items() if smallest(words[s : s + d]))


def stretches(words: np.ndarray, docs: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of what may hold runs, of the words of many documents one after another;
    ``docs`` says of each word which document it is of, and ascends.

    A run of 24 words or more and three periods q or more holds each of its windows of four
    words twice, q words apart: one that begins before the run's first q words are over is
    found q words later, where at least 3 * q - 2 * q >= 4 words are left if q >= 4, and 24 -
    2 * q >= 18 if not; each other one q words earlier. So windows met once in what is left
    of a document end a stretch, as do stretches of under 24 words, until nothing changes.
    Windows are compared by hashes: equal hashes of others only leave more words.
    """
    out, todo = [], np.arange(len(words))
    group = docs.astype(np.uint64)
    h = mix(words.astype(np.uint64) + np.uint64(1))
    for _ in range(64):
        n = len(todo)
        if n < LEAST:
            return out
        # Windows inside of one group whose words are next to each other.
        inner = np.zeros(n, bool)
        inner[: n - WINDOW + 1] = (group[: n - WINDOW + 1] == group[WINDOW - 1 :]) & (todo[WINDOW - 1 :] - todo[: n - WINDOW + 1] == WINDOW - 1)
        key = group.copy()
        for j in range(WINDOW):
            key[: n - j] = mix(key[: n - j] ^ h[todo[j:]])
        at = np.flatnonzero(inner)
        order = np.argsort(key[at], kind="stable")
        ranked = key[at][order]
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        twice = np.zeros(n, bool)
        twice[at[order]] = same[:-1] | same[1:]
        # Maximal stretches of windows met twice; their words are one group from now on.
        edge = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2] + WINDOW - 1
        far = ends - starts >= LEAST
        starts, ends = starts[far], ends[far]
        if not len(starts):
            return out
        size = ends - starts
        take = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        if len(take) == n:
            break
        todo, group = todo[take], np.repeat(np.arange(len(starts)), size).astype(np.uint64)
    cut = np.flatnonzero((group[1:] != group[:-1]) | (np.diff(todo) != 1)) + 1
    bounds = [0, *cut.tolist(), len(todo)]
    return [(int(todo[a]), int(todo[b - 1]) + 1) for a, b in zip(bounds, bounds[1:], strict=False)]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): the words from a on repeat with period p; None: the text stays as it is, as
    do those without doc_id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def of_words(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of many texts, given as words."""
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    docs = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(codes, docs):
        doc = int(docs[a])
        before = a - int(starts[doc])
        out[doc] += [(before + s, k, q) for s, k, q in runs(codes[a:b].tolist())]
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs repeat: each keeps its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


ROWS = "array<struct<start:long,length:long,period:long>>"
FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]


def _find(edit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_slice(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [(t or b"").split() for t in binary(batch.column("text"))]
            if edit is not None:
                for i, (doc, words) in enumerate(zip(ids, texts, strict=True)):
                    if (rule := edit(doc, len(words))) is not None:
                        a, p = rule
                        texts[i] = words[:a] + (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
            found = of_words(texts)
            left = [b" ".join(collapsed(w, f)) for w, f in zip(texts, found, strict=True)]
            spans = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], pa.list_(pa.struct(FIELDS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans, pa.array([x.decode("utf-8", "replace") for x in left], pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, edit=None) -> DataFrame:
    """doc_id, runs, collapsed of each row of ``docs(doc_id, text)``: its periodic runs by
    start, then period, in word numbers, and its words without what the runs repeat, joined
    by one space. ``edit(doc_id, n_words)`` may give (a, p): the words from a on are then
    those of a to a + p - 1 again and again.

    Null, empty and white texts have no runs, and collapse to nothing. Rows are independent
    of each other, whatever their doc_id; nothing is exchanged. Other columns are ignored; an
    empty table has no rows. A worker holds a slice of 4 MB, or one longer text; a text of
    which all repeats costs some 400 bytes a word in the automaton.
    """
    return docs.select("doc_id", "text").mapInArrow(_find(edit), f"doc_id long, runs {ROWS}, collapsed string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, planted)
    # Greatest exact length / period, then smallest start, then period: with no run, null.
    wins = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | ((a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] <= b["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, r: F.when(wins(acc, r), acc).otherwise(r))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    table = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    chosen = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(table, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return chosen.select("doc_id", "n_runs", F.col("b.start"), F.col("b.length"), F.col("b.period"), F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
