import hashlib
import re
from collections import defaultdict

import pytest

from forgelens.llm import mixing

from .conftest import EDGES, table


def brute(rows, share=1.5, most=2, weights=(3, 1, 2)):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    hashed = [int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16) for d, _, _ in rows]
    total = defaultdict(int)
    for s, (_, _, source) in zip(size, rows, strict=True):
        total[source] += s
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, target, budget = set(), {}, share * sum(total.values())
    while True:
        rest = budget - sum(most * total[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: float(most * total[s]) for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * total[s]]
        if not over:
            break
        full.update(over)
    out = []
    for source in order:
        base = most if total[source] == 0 or target[source] >= most * total[source] else int(target[source] // total[source])
        rest, at = target[source] - base * total[source], 0
        by_hash = defaultdict(list)
        for i, (_, _, s) in enumerate(rows):
            if s == source:
                by_hash[hashed[i]].append(i)
        open_ = rest > 0
        for h in sorted(by_hash):
            group = sum(size[i] for i in by_hash[h])
            once = open_ and (at + group <= rest or at + group - rest < rest - at)
            open_ = open_ and at + group <= rest
            at += group
            out += [(rows[i][0], size[i], total[source], round(target[source], 6), size[i] * (base + once)) for i in by_hash[h]]
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in mixing.mix(df).collect()), key=str)


def test_edges(edges, nothing):
    assert run(edges) == brute(EDGES)
    assert mixing.mix(nothing).count() == 0 and mixing.take(nothing).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_many(spark, hot):
    rows = [(d, " ".join("x" for _ in range(d * d % 97)), "hot" if hot and d % 3 else f"s{d % 7}") for d in range(900)]
    got = run(table(spark, rows))
    assert got == brute(rows)
    assert got == run(table(spark, rows[::-1]))


def test_take_repeats_rows(edges):
    want = sum(r.copies for r in mixing.mix(edges).collect())
    taken = mixing.take(edges)
    assert taken.columns == edges.columns and taken.count() == want


def test_query(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in mixing.op4_source_mix(spark, sf).collect()), key=str) == brute(rows)
