import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from forgelens.llm import audit

from .conftest import EDGES, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(doc_id, text, rows):
    text = text or ""
    w = WORD.findall(text)
    smaller = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
    hit = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]
    return {c for c, h in zip("ABCDE", hit, strict=True) if h}


def brute(rows, labels):
    """``rows`` (doc_id, text, lang), ``labels`` (doc_id, quality, toxic); row by row, order by order."""
    judged = [(p or "", fails(d, t, rows), {1 for x, q, _ in labels if x == d and d is not None and q == 1}, {1 for x, _, q in labels if x == d and d is not None and q == 1}) for d, t, p in rows]
    out = []
    for part in {p for p, *_ in judged}:
        mine, removed = [j[1:] for j in judged if j[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left, gone = mine, []
            for i, c in enumerate(order):
                here, stay = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                steps.append([part, order, i + 1, len(stay), len(here), sum(c in x[0] for x in gone), sum(x[0] == {c} for x in mine), sum(bool(x[1]) for x in here), sum(bool(x[2]) for x in here)])
                removed[c] += len(here)
                left, gone = stay, gone + here
        out += [(*s, removed[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def fixture():
    rng = random.Random(1)
    texts = ["", None, "short", "Short & Loud", "LOUD " * 250, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " 5%", "a b " * 150, "UP " * 10 + " ".join(f"w{i}" for i in range(300)), "a|b"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(80)]
    rows += [rows[3], (3, "short", "en"), (None, "short", "de"), (None, None, None), (5, "own text", "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = fixture()
    path = tmp_path_factory.mktemp("audit")
    spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, part string, bits boolean").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, good int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def collected(df):
    return sorted(tuple(r) for r in df.select(FIELDS).collect())


def test_query_of_a_fixture(spark, tables):
    rows, labels = fixture()
    assert collected(audit.op13_filter_audit(spark, tables)) == brute(rows, labels)


def test_sql_of_a_fixture(tables):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    got = con.execute(f"SELECT {', '.join(FIELDS)} FROM ({audit.OP13_SQL})").fetchall()
    assert sorted(got) == brute(*fixture())


def test_bitmaps():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        bits, mark = rng.integers(0, 32, n), rng.random(n) < 0.3
        got = audit.survivors(bits, [mark])
        assert got == [[int((bits & s == 0).sum()), int(((bits & s == 0) & mark).sum())] for s in range(32)]


def test_many_parts_are_sent_in_turns(spark, monkeypatch):
    """More parts than are held, over several packings."""
    monkeypatch.setattr(audit, "ROWS", 50)
    rows = spark.range(25_000).selectExpr("concat('p', id % 11000) AS part", "cast(id % 32 AS int) AS bits", "id % 3 = 0 AS good", "false AS toxic")
    out = audit.subsets(rows).where("subset = 0").selectExpr("count(*)", "sum(n)", "sum(good)").first()
    assert tuple(out) == (11_000, 25_000, 8334)


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = collected(audit.interactions(audit.subsets(audit.judged(edges, labels))))
    assert got == brute([(d, t, None) for d, t, _ in EDGES], [(1, 1, 0)])
    assert audit.interactions(audit.subsets(audit.judged(nothing, labels))).count() == 0
    assert len(collected(audit.interactions(audit.subsets(audit.judged(edges, labels.limit(0)))))) == 600


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert collected(audit.op13_filter_audit(spark, sf)) == brute(docs, labels)
