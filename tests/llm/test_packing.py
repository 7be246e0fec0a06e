import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from forgelens.llm import packing

from .conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bound_never_exceeds_the_best():
    rng = random.Random(2)
    for _ in range(150):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 6))]
        best = min(_first_fit(p, 12) for p in itertools.permutations(sizes))
        bound = packing.lower_bound(np.array(sizes), 12)
        assert -(-sum(sizes) // 12) <= bound <= best
    assert packing.lower_bound(np.array([7] * 5), 12) == 5 and packing.lower_bound(np.array([], int), 12) == 0


def _first_fit(sizes, capacity):
    bins = []
    for s in sizes:
        i = next((i for i, b in enumerate(bins) if b + s <= capacity), None)
        if i is None:
            bins.append(s)
        else:
            bins[i] += s
    return len(bins)


def test_best_fit():
    sizes = np.random.default_rng(3).integers(1, 1024, 3000)
    bins, offsets, n = packing.best_fit(sizes, 1024)
    check([(b, o, s) for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True)])
    assert n == bins.max() + 1 <= 1.02 * packing.lower_bound(sizes, 1024) + 1


def check(rows):
    by = defaultdict(list)
    for seq, offset, length in rows:
        by[seq].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def verify(out, docs):
    library = Tokenizer.from_file(PATH)
    n = check([(r.sequence_id, r.offset, r.length) for r in out])
    want = []
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024
        cuts = [0, *([head] if head else []), *range(head + 1024, len(ids) + 1, 1024)]
        want += [(d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    return n, -(-sum(r.length for r in out) // 1024)


def test_edges(edges, nothing):
    verify(packing.pack_documents(edges, PATH).collect(), [r[:2] for r in EDGES])
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_certificate(spark, edges):
    """bins and bound of a part are those of the pieces in it, and bound <= bins."""
    rng = random.Random(9)
    rows = [(i, i, 0, 0, rng.randint(1, 1024), 0) for i in range(900)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), 1024, per_part=200).collect()
    parts = defaultdict(list)
    for r in out:
        parts[r.sequence_id >> 28 if r.sequence_id >= 0 else r.sequence_id].append(r)
    for of in parts.values():
        assert {(r.bins, r.bound) for r in of} == {(len({r.sequence_id for r in of}), packing.lower_bound(np.array([r.length for r in of]), 1024))}
    assert all(r.bound <= r.bins for r in packing.pack_documents(edges, PATH).collect())


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = verify(packing.op7_best_fit_packing(spark, sf).collect(), docs)
    assert n <= 1.02 * least + 1


def test_parts_exchange(spark):
    """Small parts leave gaps; the exchange never makes more sequences, and loses no piece."""
    rng = random.Random(4)
    rows = [(i, i, 0, 0, rng.choice([350, 360, 500, 600, 700]), 0) for i in range(400)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    once = packing.pack(pieces, 1024, per_part=40, rounds=0).collect()
    more = packing.pack(pieces, 1024, per_part=40, rounds=3).collect()
    key = lambda rs: check([(r.sequence_id, r.offset, r.length) for r in rs])
    assert key(more) <= key(once)
    assert sorted(r.row for r in more) == list(range(400))
