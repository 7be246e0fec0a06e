"""Fingerprints of short and unspaced texts, and both levels against brute force."""

import random

from forgelens.llm import fingerprints as fp

from . import test_fingerprints as level
from .conftest import EDGES, table


def of_hashes(h, k, monkeypatch):
    """What brute() of the word level does, from the hashes of other tokens on."""
    tokens = [str(x).encode() for x in h]
    known = dict(zip(tokens, h, strict=True))
    with monkeypatch.context() as m:
        m.setattr(fp, "K", k)
        chain = level.chain
        m.setattr(level, "chain", lambda *v: known[v[0]] if len(v) == 1 and isinstance(v[0], bytes) else chain(*v))
        return level.brute(" ".join(t.decode() for t in tokens))


def brute(text, monkeypatch):
    """words, chars."""
    words = [w.decode() for w in (text or "").encode().split()]
    hashed = [x for w in words for x in ([w] if len(w) <= fp.LONG else [list(w[i : i + fp.PIECE]) for i in range(len(w) - fp.PIECE + 1)])]
    h = [level.chain(*[c.encode() for c in x]) if isinstance(x, list) else level.chain(x.encode()) for x in hashed]
    plain = " ".join(words)
    c = [level.chain(x.encode()) for x in [""] * (fp.CHARS - 1) + list(plain)] if plain else []
    return of_hashes(h, fp.K, monkeypatch), of_hashes(c, fp.CHARS, monkeypatch) if len(plain) <= fp.SHORT else None


def near(spark, rows):
    got = fp.fingerprint_edits(table(spark, [(i, t, None) for i, t in enumerate(rows)]), graded=True).collect()
    return [r.near_edited for r in sorted(got, key=lambda r: r.doc_id)]


def test_short_and_unspaced_texts_stay_like_their_edits(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    few = near(spark, [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 5, 8) * 40])
    assert sum(x == 0 for x in few) < 0.1 * len(few) and sum(few) / len(few) > 0.2
    han = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (20, 300, 3000) * 10]
    encoded = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (40, 900, 5000) * 10]
    for rows in (han, encoded):
        found = near(spark, rows)
        assert all(x > 0 for x in found) and 0.25 < sum(found) / len(found) < 0.7


def test_levels(spark, monkeypatch):
    """A short and a long text meet by words; texts around the bound, too."""
    long_, short = "word of many " * 90, "word of many " * 60

    def alike(a, b):
        rows = spark.createDataFrame([(1, a, b)], "i int, a string, b string")
        return fp.signatures(rows, ["i"], {"a": fp.F.col("a"), "b": fp.F.col("b")}, True).select(fp.print_likeness(fp.F.col("a"), fp.F.col("b"), True)).first()[0]

    assert alike(long_, short) == level.likeness(brute(long_, monkeypatch)[0], brute(short, monkeypatch)[0]) > 0
    assert alike("", None) == 1 and alike("", "word") == 0 and alike("a  b", " a\nb") == 1


def test_brute_force(spark, sf, monkeypatch):
    texts = [t for _, t, _ in EDGES] + ["语言" * 40, "x" * 25, "x" * 24, "a\U0001f600b", "y" * 1024, "y" * 1025] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").transform(lambda df: fp.signatures(df, ["i"], {"s": fp.F.col("text")}, True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.s.words, r.s.chars) == brute(texts[r.i], monkeypatch), texts[r.i][:60]
