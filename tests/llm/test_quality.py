import re
from collections import Counter

from forgelens.llm import quality

from .conftest import EDGES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for j in range(8)}
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    fails = [n < 20, 100 * len(covered) > 30 * n, 10 * symbols > n, 100 * dup > 30 * len(lines), chars < 2 * n, chars > 12 * n]
    return n, chars, symbols, dup, len(covered), fails[0] or fails[1], not any(fails), sum(1 << i for i, f in enumerate(fails) if f)


def run(df):
    base = quality.F.col("failure_bits").bitwiseAND(quality.bits(quality.BASE)) != 0
    return quality.ledger(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, quality.keeps(), "failure_bits")


def test_edges(edges, nothing):
    assert sorted(map(tuple, run(edges).collect()), key=str) == sorted(((d, *brute(t)) for d, t, _ in EDGES), key=str)
    assert run(nothing).count() == 0
    assert set(edges.columns) <= set(quality.ledger(edges).columns)


def test_query(spark, sf):
    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits"]
    got = quality.op2_quality_rules(spark, sf)
    assert {r[0]: tuple(r)[1:] for r in got.select(columns).collect()} == want
    bits = [x[-1] for x in want.values()]
    for r in got.collect():
        alone = [name for name, _ in quality.RULES if r.failure_bits == quality.bits((name,))]
        assert r.only_rule == (alone[0] if alone else "") and r.n_only_rule == (bits.count(r.failure_bits) if alone else 0)
        assert r.kept_2024_1 == (r.failure_bits & quality.bits(quality.POLICIES["2024-1"]) == 0)


def test_overlapping_spans(spark):
    text = " ".join("a b c d e f g h i".split() * 3 + [f"x{i}" for i in range(30)] + "a b c d e f g h".split())
    row = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_repeat_words == brute(text)[4] > 27


def test_ablation(edges):
    ledger = quality.ledger(edges).select("failure_bits").cache()
    bits = [r[0] for r in ledger.collect()]
    for policy, names in quality.POLICIES.items():
        mask = quality.bits(names)
        for r in quality.ablation(ledger, policy).collect():
            bit = quality.bits((r.rule,))
            assert (r.failed, r.only_this, r.kept_without) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))
