import random

import pytest

from forgelens.llm import graphs, near_dup

from .conftest import EDGES, WORDS, table


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(shingles(t, width))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(((d, len(shingles(t, width)), None if d is None else find(d), d is None or find(d) == d) for d, t in rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_edges(edges, nothing, width, percent):
    assert rows_of(near_dup.near_duplicates(edges, width, percent)) == brute([r[:2] for r in EDGES], width, percent)
    assert near_dup.near_duplicates(nothing, width, percent).count() == 0


def test_straddling_group(spark):
    """Copies with one to eight edits each: some pairs are just alike enough, some not."""
    rng, rows = random.Random(5), []
    base = [rng.choice(WORDS) for _ in range(120)]
    for d in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(120)] = rng.choice(WORDS[:12])
        rows.append((d, " ".join(words)))
    rows += [(1000 + d, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90)))) for d in range(100)]
    rng.shuffle(rows)
    assert rows_of(near_dup.near_duplicates(table(spark, [(d, t, None) for d, t in rows]), 3, 85)) == brute(rows, 3, 85)


def test_ids_with_several_texts(spark):
    """Each text of a doc_id links by itself; the doc_id's rows are one document."""
    a, b = " ".join(WORDS[100:180]), " ".join(WORDS[:80])
    rows = [(5, a), (5, b), (9, a + " more"), (3, b + " more"), (8, ""), (8, None), (8, b + " most"), (4, "alone"), (4, " "), (7, "x y z"), (6, "x y z"), (6, "q r s"), (2, "q r s"), (None, a), (11, "alone")]
    for width, percent in ((3, 85), (5, 80)):
        assert rows_of(near_dup.near_duplicates(table(spark, [(d, t, None) for d, t in rows]), width, percent)) == brute(rows, width, percent)


def test_dense_clusters_in_blocks(spark, monkeypatch):
    """Clusters of several small blocks, and centres of several runs, give the same links."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "RUN", 5)
    rng, rows = random.Random(8), []
    for base in ([rng.choice(WORDS) for _ in range(100)] for _ in range(3)):
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(100)] = rng.choice(WORDS[:9])
            rows.append((len(rows), " ".join(words)))
    assert rows_of(near_dup.near_duplicates(table(spark, [(d, t, None) for d, t in rows]), 3, 85)) == brute(rows, 3, 85)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(near_dup.op3_near_duplicates(spark, sf)) == brute(rows, 3, 85)


def test_every_coordinate_fills():
    import numpy as np

    sets = [np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 2, 7, 300)]
    out = near_dup.sketch(sets, 140)
    assert (out != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    alike = near_dup.sketch([np.sort(sets[3][:270]), np.sort(sets[3][30:])], 2000)
    assert abs((alike[0] == alike[1]).mean() - 0.8) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 300)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 150: 150, 200: 150, 300: 150}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
