"""Keyword links against brute force."""

import os
import re

import pytest

from forgelens.operators import relational
from forgelens.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(items, docs, least=3):
    keys, texts = {}, {}
    for i, t in items:
        keys.setdefault(i, set()).update(re.findall(r"[^\W\d_]{4,}", (t or "").lower()))
    for d, t in docs:
        texts.setdefault(d, []).append((t or "").lower())
    links = ((i, d, sum(any(k in t for t in ts) for k in ks)) for i, ks in keys.items() for d, ts in texts.items())
    return sorted((x for x in links if x[2] >= least), key=str)


def test_links(spark):
    items = [(3, "Müller reads some maps"), (7, "blue blue blue lake"), (90, "Some reads, müller!"), (91, None), (92, "one two six")]
    docs = [(1, "awesome MÜLLERS threads"), (1, "and a roadmap's mapsheet"), (2, "blue lakes"), (3, None), (4, "somereadsmüllermaps"), (None, "some müller reads")]
    got = relational.keyword_links(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), "item_id", "doc_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute(items, docs)
    assert {r[0] for r in brute(items, docs)} == {3, 90}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_all_items(spark):
    items, docs = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    got = sorted(map(tuple, catalogue.QUERIES["keyword_substring_join"](spark, SF).collect()), key=str)
    assert got == brute(items, docs)
    assert len({r[0] for r in got}) > 5  # not only those with item_id < 5


def test_tasks_grow_with_the_documents(spark, monkeypatch):
    """What a task groups stays the same, whatever the number of documents."""
    monkeypatch.setattr(relational, "TASK_TEXTS", 10)
    items = spark.createDataFrame([(1, "some blue lake")], "item_id long, text string")
    docs = spark.range(400).selectExpr("id AS doc_id", "'some blue lakes' AS text")
    got = relational.keyword_links(items, docs, "item_id", "doc_id")
    assert got.rdd.getNumPartitions() == 40 and got.count() == 400
