import hashlib
from itertools import pairwise

import xxhash

from forgelens.llm import fingerprints as fp

from .conftest import EDGES, table

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*values):
    """Spark's xxhash64 of strings and longs."""
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else (v & MASK).to_bytes(8, "little") if not isinstance(v, Int) else (v & 0xFFFFFFFF).to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


class Int(int):
    """A 32-bit number."""


def brute(text):
    words = (text or "").encode().split()
    h = [chain(w) for w in words]
    if not h:
        return []
    kmers = [chain(*h)] if len(h) < fp.K else [chain(*h[i : i + fp.K]) for i in range(len(h) - fp.K + 1)]
    seen, numbered = {}, []
    for k in kmers:
        n = seen[k] = seen.get(k, -1) + 1
        numbered.append(k if n == 0 else chain(k, Int(n)))
    out, n = [], len(numbered)
    for of in range(fp.LISTS):
        turn = 64 // fp.LISTS * of
        turned = [signed(((x << turn) | ((x & MASK) >> (64 - turn))) & MASK) if turn else x for x in numbered]
        s = sorted((t >> fp.PLACE_BITS, (p << fp.PLACE_BITS) // n) for p, t in enumerate(turned))
        for start in fp.starts(of):
            at = sum(x[0] << fp.PLACE_BITS < start for x in s)
            x, y = s[at % n], s[(at + 1) % n]
            x, y = (x, y) if x[1] <= y[1] else (y, x)
            out.append(chain(x[0], y[0]) & ((1 << fp.TUPLE_BITS) - 1))
    return out


def likeness(a, b):
    if not a and not b:
        return 1.0
    return sum(x == y for x, y in zip(a, b, strict=False)) / fp.TUPLES


def brute_rows(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (d, t), (_, after) in pairwise([*rows, rows[0]]):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = brute(t), brute(edited), brute(after)
        text = lambda s: "".join(f"{x:08x}" for x in s)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def test_edges(edges, nothing):
    for per_range in (2000, 3):
        assert sorted(map(tuple, fp.fingerprint_edits(edges, per_range=per_range).collect()), key=str) == brute_rows([r[:2] for r in EDGES])
    assert fp.fingerprint_edits(nothing).count() == 0


def test_ranges(spark, monkeypatch):
    """Many ranges, clustered ids and ids that repeat."""
    rows = [(d // 3 if d < 90 else 10**12 + d * d, f"text {d % 11} of {d}", None) for d in range(200)] + [(None, "x", None)]
    df = table(spark, rows)
    got = fp.with_next(df.select("doc_id", "text"), ["text"], per_range=7).collect()
    order = sorted(((d, t) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(d, t, n) for (d, t), (_, n) in pairwise([*order, order[0]])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_order_counts(spark):
    a, b = " ".join(f"q{i}" for i in range(300)), " ".join(f"q{i}" for i in [*range(150, 300), *range(150)])
    found = fp.signatures(spark.createDataFrame([(a, b)], "a string, b string").withColumn("i", fp.F.lit(1)), ["i"], {"a": fp.F.col("a"), "b": fp.F.col("b")})
    row = found.select(fp.likeness(fp.F.col("a.words"), fp.F.col("b.words")).alias("x"), fp.likeness(fp.F.col("a.words"), fp.F.col("a.words")).alias("y")).first()
    assert row.y == 1 and 0.2 < row.x < 0.8  # as sets of words, or of shingles, they are all but equal


def test_likeness_is_the_share_of_common_neighbours(spark):
    """Over many pairs the likeness of a text and its edit comes near the share of orders whose
    two least k-mers agree for a random order: within two standard errors of 64 of them."""
    import random

    rng = random.Random(1)
    rows, want = [], []
    for i in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        b = a[:300] + [f"v{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((i, " ".join(a), " ".join(b)))
        common, either = 298, 398 * 2 - 298
        want.append(common * (common - 1) / (either * (either - 1)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = [r.x for r in fp.signatures(df, ["i"], {"a": fp.F.col("a"), "b": fp.F.col("b")}).select(fp.likeness(fp.F.col("a.words"), fp.F.col("b.words")).alias("x")).collect()]
    mean, p = sum(got) / len(got), sum(want) / len(want)
    assert abs(mean - p) < 2 * (p * (1 - p) / 64 / 60) ** 0.5 + 0.01
    assert (sum((x - mean) ** 2 for x in got) / len(got)) ** 0.5 < 1.3 * (p * (1 - p) / 64) ** 0.5


def test_many_ranges_are_searched(spark, monkeypatch):
    """More ranges than any fixed list had: each row finds its own by halving."""
    df = spark.range(0, 30_000, 3).select(fp.F.col("id").alias("doc_id"), fp.F.col("id").cast("string").alias("text"))
    monkeypatch.setattr(fp.math, "isqrt", lambda n: 1)
    got = fp.with_next(df, ["text"], per_range=2)
    assert got.where("next_text <> cast(CASE WHEN doc_id = 29997 THEN 0 ELSE doc_id + 3 END AS string)").count() == 0 and got.count() == 10_000


def test_query(spark, sf):
    """The rows of the query, by the words' level, against brute force (the other level: see
    test_graded_fingerprints)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, fp.fingerprint_edits(docs).collect()), key=str) == brute_rows(rows)
    got = {r.doc_id: r for r in fp.op5_order_fingerprints(spark, sf).collect()}
    for d, n, sha, *_ in brute_rows(rows):
        assert (got[d].n_chars, got[d].edited_sha256) == (n, sha) and 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
