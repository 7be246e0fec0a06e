"""Runs of which base spans cover a part: the models judge the rest."""

import re

from forgelens.llm import secrets

from .conftest import table
from .test_secrets import HEX, KEY, ODD, base

REST = ODD.rstrip("=")[:40]
TEXTS = [f"{KEY}/{REST}", f"see {REST}_{HEX[:24]} here", f"{REST}-{HEX[:30]}-{REST}", f"{KEY}/{REST[:12]}", f"{HEX[:24]}_{REST[:18]}", f"é {KEY}/path/to/the/ordinary_document_name", f"{REST}/token={HEX}", f"a {HEX[:24]}_{HEX[:24]}_{REST} {ODD}"]


def parts(text):
    spans = base(text)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        free = [not any(s <= i < e for s, _, e, _ in spans) for i in range(m.start(), m.end())]
        for part in re.finditer("1+", "".join("01"[x] for x in free)):
            yield m.start() + part.start(), m.start() + part.end()


def test_parts(spark):
    model = secrets.train(secrets.samples(spark))
    df = secrets.scan(table(spark, [(i, t, None) for i, t in enumerate(TEXTS)]), model)
    clean = secrets.redact(secrets.F.col("text"), secrets.F.col("secret_spans")).alias("clean")
    rows = sorted(df.select("doc_id", "secret_spans", clean).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(TEXTS)
    for r in rows:
        text, found = TEXTS[r.doc_id], {(x.s, x.e) for x in r.secret_spans if x.kind == "markov"}
        want = {(s, e) for s, e in parts(text) if secret(text[s:e], model)}
        assert found == want, text
        assert {tuple(x) for x in r.secret_spans if x.kind != "markov"} == set(base(text))
        assert REST not in r.clean
    assert REST[:18] not in rows[4].clean
    assert "ordinary_document_name" in rows[5].clean


def secret(part, model):
    at = ["abcdefghijklmnopqrstuvwxyz".find(c) if c.islower() else 26 if c.isupper() else 27 if c.isdigit() else 28 for c in part]
    return sum(model[a * 29 + b] for a, b in zip(at, at[1:], strict=False)) >= secrets.THRESHOLD
