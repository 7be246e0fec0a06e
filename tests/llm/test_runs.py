import hashlib
import random
import re
import time
import zlib

import numpy as np

from forgelens.llm import runs

from .conftest import EDGES, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Each period by itself: stretches of words that equal those q before."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(24, 3 * q) and not any(all(w[k] == w[k + f] for k in range(i, i + size - f)) for f in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    k, w = rng.choice([1, 2, 2, 3, 5, 50]), []
    while len(w) < rng.randint(0, 200):
        if rng.random() < 0.5 and w:
            block = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
            w += (block * 20)[: rng.randint(1, 70)]
        else:
            w += [rng.randrange(k) for _ in range(rng.randint(1, 30))]
    return w


def test_random_texts():
    """The automaton alone, and behind the cut, over texts of few words that repeat a lot."""
    rng = random.Random(4)
    texts = [some_words(rng) for _ in range(1500)]
    got = runs.of_words([[b"%d" % x for x in t] for t in texts])
    found = 0
    for t, g in zip(texts, got, strict=True):
        want = brute(t)
        found += len(want)
        assert g == want == runs.runs(t)
    assert found > 1000


def test_bounds():
    """23 words are no run, 24 are; two and a half periods are none, three are."""
    one = lambda w: runs.of_words([[x.encode() for x in w]])[0]
    assert one(["a"] * 23) == [] and one(["a"] * 24) == [(0, 24, 1)]
    block = [f"w{i}" for i in range(20)]
    assert one(block * 3) == [(0, 60, 20)] and one((block * 3)[:59]) == []
    assert one(["x", *block * 3, "w0", "y"]) == [(1, 61, 20)]
    # Blocks that repeat with a repetition inside: the inner run is one of its own.
    inner = ["a"] * 30 + block
    assert one(inner * 3) == [(0, 30, 1), (0, 150, 50), (50, 30, 1), (100, 30, 1)]


def test_cut_loses_no_run():
    rng = random.Random(8)
    texts = [some_words(rng) for _ in range(400)]
    sizes = [len(t) for t in texts]
    flat = np.array([x for t in texts for x in t])
    kept = runs.stretches(flat, np.repeat(np.arange(len(texts)), sizes))
    starts = np.cumsum([0, *sizes])
    for i, t in enumerate(texts):
        for s, k, _ in brute(t):
            assert any(a <= starts[i] + s and starts[i] + s + k <= b for a, b in kept)


def test_ordered_set():
    rng = random.Random(2)
    numbers = rng.sample(range(100_000), 6000)
    ends, known = runs.Ends(numbers[0]), {numbers[0]}
    for i, x in enumerate(numbers[1:]):
        got = ends.add(x)
        if i % 50 == 0:
            assert got == (max((k for k in known if k < x), default=-1), min((k for k in known if k > x), default=-1))
        known.add(x)
    assert list(ends) == sorted(numbers) and ends.size == len(numbers)


def test_long_texts_in_time():
    """One word 200,000 times, a period of 1,000, and two words at random."""
    rng, began = random.Random(3), time.perf_counter()
    assert runs.of_words([[b"a"] * 200_000])[0] == [(0, 200_000, 1)]
    assert runs.of_words([[b"%d" % (i % 1000) for i in range(200_000)]])[0] == [(0, 200_000, 1000)]
    runs.of_words([[b"%d" % rng.randrange(2) for _ in range(100_000)]])
    assert time.perf_counter() - began < 60


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    table_text = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(table_text), digest(left))


def fixture(sf_rows=()):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{x}" for x in some_words(rng)), None) for i in range(20, 320)]
    return rows + list(sf_rows)


def test_query_of_a_fixture(spark, tmp_path):
    rows = fixture([(d, t, s) for d, t, s in EDGES if d != 8])
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(d, t) for d, t, _ in rows), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows if d is not None) > 10


def test_edges(edges, nothing):
    got = {(r.doc_id, r.collapsed): r.runs for r in runs.periodic_runs(edges).collect()}
    assert got[(2, "")] == got[(4, "")] == got[(None, "")] == []
    assert len(got) == len({(d, " ".join(WORD.findall(t or ""))) for d, t, _ in EDGES})
    assert runs.periodic_runs(nothing).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = runs.op12_periodic_runs(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows)
    for r in rows:
        if len(WORD.findall(docs[r.doc_id])) <= 400:  # brute force is quadratic
            assert tuple(r) == expected(r.doc_id, docs[r.doc_id])
