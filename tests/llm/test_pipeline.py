"""The stages against brute force, and the oracles against DuckDB."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from forgelens.llm import mixing, queries, secrets
from forgelens.llm.common import staged

from .conftest import EDGES
from .test_mixing import brute as mixed
from .test_near_dup import brute as grouped
from .test_packing import verify
from .test_quality import brute as measured
from .test_secrets import brute as found


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def expected(rows, model):
    rows = [r for r in rows if measured(r[1])[6]]
    yield rows
    kept = Counter(g[0] for g in set(grouped([r[:2] for r in rows], 5, 80)) if g[3])
    best = {}
    for r in sorted(rows, key=str):
        if r[0] is not None and r[0] in kept:
            best[r[0]] = min(best.get(r[0], r), r, key=lambda x: x[1] or "")
    rows = [*best.values(), *(r for r in rows if r[0] is None)]
    yield rows

    def clean(text):
        out, at = "", 0
        for s, _, e, _ in found(text, model):
            if s >= at:
                out += (text or "")[at:s] + "[SECRET]"
            at = max(at, e)
        return (text or "")[at:] if not at else out + text[at:]

    rows = [(d, None if t is None else clean(t), s) for d, t, s in rows]
    yield rows
    taken = Counter()
    for d, size, _, _, words in mixed(rows):
        taken[d] = words // size if size else 0
    yield [r for r in rows for _ in range(taken[r[0]])]


def check(spark, docs, sf_dir):
    model, threshold = secrets.calibrated(secrets.samples(spark))
    assert threshold == secrets.THRESHOLD
    want = expected(rows_of(docs), model)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert rows_of(docs) == sorted(next(want), key=str), name
    verify(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark, edges):
    check(spark, edges.where("doc_id IS NOT NULL OR text IS NOT NULL"), "")


def test_nothing(spark, nothing):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_documents(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda df: sorted(tuple(re.sub("^(None|nan|NaN)$", "NULL", str(x)) for x in r) for r in df[columns].itertuples(index=False))
    assert text(got) == text(want)


def test_sizes():
    assert len(EDGES) > 10 and mixing.WEIGHTS == (3, 1, 2)
