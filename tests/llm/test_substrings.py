import hashlib
import random

import pytest

from forgelens.llm import substrings

from .conftest import EDGES, table

LAST = 1 << 63


def brute(rows, window):
    first = {}
    for d, t in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - window + 1):
            k = tuple(words[i : i + window])
            first[k] = min(first.get(k, LAST), LAST - 1 if d is None else d)
    out = []
    for d, t in rows:
        words = (t or "").encode().split()
        gone = {i + j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < (LAST - 1 if d is None else d) for j in range(window)}
        out.append((d, len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def run(df, window):
    rows = substrings.repeated_words(df, window).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


@pytest.mark.parametrize("window", [3, 13, 30])
def test_edges(edges, nothing, window):
    assert run(edges, window) == brute([r[:2] for r in EDGES], window)
    assert run(nothing, window) == []


@pytest.mark.parametrize("window", [13, 26])
def test_shared_passages(spark, window):
    """Passages that many documents share, a copied group, and rows that share a doc_id."""
    rng = random.Random(window)
    word = lambda: f"v{rng.randrange(30)}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 25, 26, 60)]
    rows = [(d, " ".join(x for _ in range(4) for x in ([word() for _ in range(rng.randint(0, 25))] + rng.choice(passages)))) for d in range(120)]
    rows += [(500 + d, rows[3][1]) for d in range(40)] + [(7, "another text of seven " + rows[9][1]), (7, rows[9][1])]
    rng.shuffle(rows)
    assert run(table(spark, [(d, t, None) for d, t in rows]), window) == brute(rows, window)


def test_levels():
    assert substrings.levels(13) == [4, 8, 13]
    for window in range(1, 200):
        found = substrings.levels(window)
        assert found[-1] == window and all(b == min(2 * a, window) for a, b in zip(found, found[1:], strict=False))


def test_first_hashes_that_clash(spark, monkeypatch):
    """With 10 bits in place of LOW nearly all first hashes clash; the second decides."""
    monkeypatch.setattr(substrings, "LOW", 10)
    rng = random.Random(4)
    rows = [(d, " ".join(f"u{rng.randrange(3000)}" for _ in range(1500))) for d in range(2)]
    rows += [(9, rows[0][1] + " and " + " ".join(rows[1][1].split()[200:900])), (8, "new " + " ".join(f"z{i}" for i in range(900)))]
    assert run(table(spark, [(d, t, None) for d, t in rows]), 13) == brute(rows, 13)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = substrings.op6_repeated_passages(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 13)


def test_nothing_is_left_in_the_catalog(spark, edges):
    before = {t.name for t in spark.catalog.listTables()}
    got = substrings.repeated_words(edges)
    assert {t.name for t in spark.catalog.listTables()} == before and got.count() == len(EDGES)
