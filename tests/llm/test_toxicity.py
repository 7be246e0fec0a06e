import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from forgelens.llm import toxicity as tox

from .conftest import EDGES, table

STEMS = ["zorgl", "blimpfen", "quackadoodle"]
LEXICON = tox.Lexicon(tox.SEEDS, STEMS)


def distances(a, b):
    """The edit distance of ``a`` to each prefix of ``b``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def nearest(word, terms=tuple(tox.SEEDS), stems=tuple(STEMS)):
    """Letters of the longest term or stem that the word is near."""
    sizes = [len(t) for t in terms if distances(t, word)[-1] <= LEXICON.distance(t)]
    return max(sizes + [len(t) for t in stems if min(distances(t, word)) <= LEXICON.distance(t, tox.PREFIX)], default=0)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from([*tox.SEEDS, *STEMS, *(s + "schaften" for s in STEMS)]), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12), st.sampled_from("aeioumnst")), max_size=3))
def test_automaton(term, edits):
    word = list(term)
    for kind, at, c in edits:
        at = min(at, len(word))
        if kind == 0:
            word.insert(at, c)
        elif at < len(word):
            word[at : at + 1] = [] if kind == 1 else [c]
    word = "".join(word)
    near = nearest(word)
    assert LEXICON.fuzzy(word) == near
    if near and word not in tox.SEEDS and not any(word.startswith(s) for s in STEMS):
        assert not word or LEXICON._near(word)


def test_misspelled_and_masked_words():
    for word in (b"idiot", b"Idiot!", b"idiiot", b"id1ot", b"patethic", b"worthles,", b"m0ron", b"\"clown\"", b"you,idiot/clown", b"i.d.i.o.t", b"zorglung", b"blimpfenschaft", b"blimpfn", b"blimpvenschaft"):
        assert LEXICON.judge(word), word
    for word in (b"idea", b"path", b"cloud", b"the", b"", b"scale", b"string", b"x" * 5000, b"1-2-3", b"path/to.the:cloud"):
        assert not LEXICON.judge(word), word
    assert not tox.Lexicon(tox.SEEDS, [], ["idiiot"]).judge(b"idiiot")


def test_long_words_are_judged():
    tail = b"donaudampfschifffahrtsgesellschaftskapitaen" * 3
    assert LEXICON.judge(b"zorgl" + tail) == LEXICON.judge(b"blimpfen" + tail) == tox.EXACT
    assert LEXICON.judge(b"blimpven" + tail) == tox.FAR and LEXICON.judge(tail + b"-idiot") == tox.EXACT
    assert LEXICON.judge(tail + b"zorgl") == tox.NONE


def test_quotation_is_not_abuse():
    judged = tox._Judged(LEXICON)
    abuse, quote, said = (tox.features(t, judged) for t in (b"you are a stupid idiot", b'the word "idiot" is rude', b"the manual calls such a loop stupid"))
    score = lambda x: 1 / (1 + tox.np.exp(-(tox.np.array(x) @ tox.PRIOR)))
    assert score(abuse) > 0.9 > 0.3 > max(score(quote), score(said))
    assert tox.features(b"", judged)[1:] == [0.0] * 6


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (5, 0), (5, 1), (99, 1)], "doc_id long, toxic int")
    rows = tox.score(edges, labels).collect()
    assert sorted((str(r.doc_id) for r in rows)) == sorted(str(r[0]) for r in EDGES)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert tox.score(nothing, labels).count() == 0
    assert tox.score(edges, labels.limit(0)).count() == len(EDGES)


def test_learns_unknown_terms(spark):
    """Terms outside of the seeds, known from labels alone, are found in held-out rows, as
    they are and misspelled. (Near copies count once, so the texts differ.)"""
    rows = [(d, f"plain words number {d} q{d * 7} of r{d * d} the s{d} text " + ("" if d % 5 else "knubbelwutz " if d % 2 else f"zorgl{'abcdef'[d % 6]} ") + "until the end", None) for d in range(400)]
    labels = spark.createDataFrame([(d, int(d % 5 == 0)) for d in range(400)], "doc_id long, toxic int")
    got = tox.score(table(spark, rows), labels).where("held_out").collect()
    assert len(got) > 50 and all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in got)
    more = [(1000 + d, f"other plain text {d} has {w} and ends", None) for d, w in enumerate(["knubelwutz", "knubbelwotz", "knuxbelwutz", "knubbelwutzz", "k.n.u.b.b.e.l.w.u.t.z", "table", "plain,words", "knowledge"])]
    found = {r.doc_id: r.score >= 0.3 for r in tox.score(table(spark, rows + more), labels).where("doc_id >= 1000").collect()}
    assert found == {1000 + d: d < 5 for d in range(8)}


def brute(docs, labels, spark):
    """score() in plain Python: whole tables as lists, edit distances for the automaton."""
    of = defaultdict(list)
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            of[d].append(y)
    hashes = dict(map(tuple, spark.createDataFrame([(d,) for d in of], "d long").selectExpr("d", "pmod(xxhash64(d, 1), 3)").collect()))
    text_of = {d: min((t for i, t in docs if i == d and t is not None), default=None) for d in of if any(i == d for i, _ in docs)}
    read = [(text_of[d], max(of[d])) for d in text_of if hashes[d] != 0]
    weigh = [(text_of[d], max(of[d])) for d in text_of if hashes[d] == 0]
    seen = defaultdict(dict)
    for t, y in read:
        words = (t or "").encode().split()
        plain = {w.strip(tox._EDGE).decode().lower() for w in words}
        plain = {w for w in plain if w.isalpha() and len(w) >= 4}
        for key in [(w, 0) for w in plain] + [(w[:k], 1) for w in plain for k in range(4, min(12, len(w)) + 1)]:
            sig = tox._signature(words)
            seen[key][sig] = max(y, seen[key].get(sig, 0))
    enough = max(4, -(-2 * sum(y for _, y in read) // 100))
    pure = [k for k, v in seen.items() if sum(v.values()) >= enough and sum(v.values()) >= 0.8 * len(v)]
    terms = {*tox.SEEDS, *(w for w, k in pure if not k)}
    stems = {w for w, k in pure if k}
    stems = {s for s in stems if not any(s[:k] in stems for k in range(4, len(s)))}

    def letters(w, ordinary):
        if len(w) < 3:
            return 0
        if w in terms or any(w.startswith(s) for s in stems):
            return 1
        size = 0 if w in ordinary else nearest(w, tuple(terms), tuple(stems))
        return 0 if not size else 2 if size >= 8 else 3

    def runs(form):
        found = re.findall(r"[^\W\d_]+", form)
        return ["".join(found)] if len(found) > 2 and all(len(x) == 1 for x in found) else found

    ordinary = {x for t, y in read if not y for x in re.findall(r"[^\W\d_]+", (t or "").lower()) if letters(x, ()) > 1}
    known = {}

    def judge(w):
        if w not in known:
            plain = w.decode().lower().strip(tox._AROUND)
            if plain.isalpha():
                known[w] = letters(plain, ordinary)
            else:
                found = [letters(x, ordinary) for x in runs(plain)] + [max(2, v) for x in runs(plain.translate(tox._LEET)) if (v := letters(x, ordinary))]
                known[w] = min((x for x in found if x), default=0)
        return known[w]

    def row(t):
        words = (t or "").encode().split()
        return tox.context(words, [judge(w) for w in words])

    weights = tox.fit(np.array([row(t) for t, _ in weigh]).reshape(-1, len(tox.PRIOR)), np.array([y for _, y in weigh], float))
    return sorted(((d, round(float(1 / (1 + np.exp(-np.array(row(t)) @ weights))), 9)) for d, t in docs), key=str)


def test_score_against_brute_force(spark):
    """Labelled prose with insults, misspelled ones, quotations, unknown terms and copies."""
    import random

    rng = random.Random(11)
    base = [f"{a}{b}{c}" for a in ("lo", "ma", "ti", "cro") for b in ("ser", "nd", "gu") for c in ("", "en", "al")]
    bad = ["idiot", "idiiot", "lozer", "loser", "m0ron", '"clown"', "glorpf", "glorpfling", "glorpfster", "worthles", "you,scum", "schnarzelpuff", "schnarzelpufff"]
    docs = []
    for d in range(160):
        words = [rng.choice(base) for _ in range(rng.randint(3, 25))]
        if d % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((d, " ".join(words)))
    docs += [(200 + i, docs[4 * i][1]) for i in range(10)] + [r[:2] for r in EDGES if r[0] != 8] + [(5, None), (300, "You, loser!\tsaid  she\nidiot")]
    labels = [(d, int(d % 4 == 0)) for d in range(150)] + [(200 + i, 1) for i in range(10)] + [(5, 1), (5, None), (None, 1), (2, 0)]
    got = tox.score(table(spark, [(d, t, None) for d, t in docs]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sorted(((r.doc_id, round(r.score, 9)) for r in got), key=str) == brute(docs, labels, spark)


def test_held_out_accuracy(spark):
    import os

    import pytest

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = tox.op9_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85
    assert sum(r.predicted for r in rows if not r.toxic) / (len(rows) - len(toxic)) < 0.01
