"""Toxicity: a lexicon in a trie, met by Levenshtein automata, and windows of context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, kept, per_slice, staged

#: Insults that count without any label, in four languages.
SEEDS = """
arsehole asshole bastard bitch bullshit clown cretin crap cunt dickhead disgusting dumbass dumb filth fool freak garbage idiot idiotic imbecile
jerk loser lunatic maggot moron moronic nitwit pathetic pig prick psycho retard scum scumbag shit shithead slut sucker stupid
trash twat twit ugly vermin weirdo whore worthless wanker
abschaum arschloch blödmann dreckskerl dummkopf hurensohn idiotin mistkerl schwachkopf trottel versager wichser
abruti connard connasse crétin débile enculé imbécile minable ordure salaud salope
asqueroso basura cabrón estúpido gilipollas idiota imbécil mierda pendejo puta
""".split()
QUOTING = frozenset(b"said says wrote called calls word words term terms quote quoted quotes means meaning insult insults slur slurs define defined example".split())
DIRECT = frozenset(b"you your you're youre yours u ur yourself he she they du dein deine ihr tu ton ta vous eres tienes".split())
OPEN, CLOSE = (b'"', b"'", "“".encode(), "«".encode(), "„".encode(), "‘".encode()), (b'"', b"'", "”".encode(), "»".encode(), "“".encode(), "’".encode())
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LEET = str.maketrans("013457@$", "oieastas")
_AROUND = _EDGE.decode() + "“”«»„‘’¿¡…"
_LETTERS = re.compile(r"[^\W\d_]+")
WINDOW = 5
#: Bound on the labelled rows that the lexicon and the weights are learned from.
SAMPLE = 12_000
#: Weights before any label is seen: bias, exact and far, what far counts more than exact,
#: near, quoted, directed, share. So a misspelled long term counts like an exact one, but for
#: what labels say against it.
PRIOR = np.array([-4.0, 4.0, 0.0, 1.0, 0.5, 1.0, 1.0])
#: What a word is judged: no term, a term or a stem's word, near a term of LENGTHY letters or
#: more, near a shorter one (by chance, ordinary words are).
NONE, EXACT, FAR, NEAR = 0, 1, 2, 3
LENGTHY = 8
WHOLE, PREFIX = "", "*"  # what a trie's node has where a term, or a stem, ends


def _letter_bits(word: str) -> int:
    """A bit for each kind of letter. One edit takes away or adds one kind at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


class Lexicon:
    """Terms (accepted as whole words), stems (accepted as what a word begins with) and
    ordinary words, which are no misspelling of either. Terms and stems stand in a trie, one
    for each length of words; look-ups of exact ones only save its walk."""

    def __init__(self, terms: list[str], stems: list[str], ordinary: list[str] | tuple[str, ...] = ()):
        self.terms, self.stems, self.ordinary = frozenset(terms), frozenset(stems), frozenset(ordinary)
        self.widths = sorted({len(s) for s in stems})
        self.shapes: dict[tuple[int, int, bool], set[str]] = {}
        self.checks: dict[int, list] = {}
        self.tries: dict[int, dict] = {}
        for words, end in ((self.terms, WHOLE), (self.stems, PREFIX)):
            for word in words:
                self.shapes.setdefault((len(word), self.distance(word, end), end == WHOLE), set()).add(word)
        self.longest = max(map(len, self.terms | self.stems), default=0) + 3

    @staticmethod
    def distance(word: str, end: str = WHOLE) -> int:
        """Edits that are allowed: two from 8 letters on, one from 5; one in stems, whose
        words go on, from 7 on."""
        if end == PREFIX:
            return int(len(word) >= 7)
        return 2 if len(word) >= 8 else int(len(word) >= 5)

    def _fits(self, n: int) -> Iterator[tuple[int, int, bool, set[str]]]:
        """Length, distance, whether whole words, and these, of all that a word of n letters
        can be near."""
        for (size, k, whole), words in self.shapes.items():
            if n >= size - k and (n <= size + k or not whole):
                yield size, k, whole, words

    def trie(self, n: int) -> list[tuple[int, dict]]:
        """The terms and stems that a word of n letters can be near, as a trie for each
        distance."""
        if n not in self.tries:
            roots: dict[int, dict] = {}
            for _, k, whole, words in self._fits(n):
                for word in words:
                    node = roots.setdefault(k, {})
                    for c in word:
                        node = node.setdefault(c, {})
                    node[WHOLE if whole else PREFIX] = word
            self.tries[n] = sorted(roots.items(), key=lambda x: x[0])
        return self.tries[n]

    def _parts(self, n: int) -> list[tuple[int, int, dict[str, list[tuple[int, int, bool]]]]]:
        """For words of n letters: where a part of a term may stand unchanged, and of the terms
        with that part their letters, distances, and whether they are whole words. k edits
        leave one of a term's k + 1 parts whole, moved by k places at most."""
        found: dict[tuple[int, int], dict[str, list]] = {}
        for size, k, whole, words in self._fits(n):
            if not k:
                continue
            cuts = [size * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                # a whole word's first part stands first, and its last one last
                moved = {0} if a == 0 else {n - size} if whole and b == size else range(-k, k + 1)
                for d in moved:
                    if a + d >= 0 and b + d <= n:
                        at = found.setdefault((a + d, b + d), {})
                        for w in words:
                            at.setdefault(w[a:b], []).append((_letter_bits(w), k, whole))
        return sorted(((a, b, x) for (a, b), x in found.items()), key=lambda x: x[:2])

    def _near(self, word: str) -> bool:
        """Whether the word keeps a part of a term, or stem, and all its letters but as many
        as edits can take; else no automaton is needed."""
        n = len(word)
        if n not in self.checks:
            self.checks[n] = self._parts(n)
        own = 0
        for a, b, terms in self.checks[n]:
            for bits, k, whole in terms.get(word[a:b], ()):
                own = own or _letter_bits(word)
                if (bits & ~own).bit_count() <= k and not (whole and (own & ~bits).bit_count() > k):
                    return True
        return False

    def fuzzy(self, word: str) -> int:
        """Letters of the longest term that the Levenshtein automaton of the word accepts
        within the term's distance, or of a stem that it accepts when stopped at some place;
        0 if none. The automaton's state is a bit set of places in the word for each number
        of edits; it walks down the trie and leaves a branch when no place is left."""
        n, masks = len(word), {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        places, best = (2 << n) - 1, 0
        for k, root in self.trie(n):
            stack = [(root, 1, 0b11 if k else 0, 0b111 if k == 2 else 0)]
            while stack:
                node, r0, r1, r2 = stack.pop()
                for c, child in node.items():
                    if c == WHOLE or c == PREFIX:
                        state = r0 | r1 | r2
                        if len(child) > best and (state >> n & 1 if c == WHOLE else state & places):
                            best = len(child)
                        continue
                    m = masks.get(c, 0)
                    n0 = (r0 & m) << 1
                    n1 = (r1 & m) << 1 | r0 | (r0 | n0) << 1 if k else 0
                    n2 = (r2 & m) << 1 | r1 | (r1 | n1) << 1 if k == 2 else 0
                    if (n2 or n1 or n0) & places:
                        stack.append((child, n0, n1, n2))
        return best

    def _letters(self, form: str) -> int:
        if len(form) < 3:
            return NONE
        if form in self.terms or any(form[:k] in self.stems for k in self.widths):
            return EXACT
        form = form[: self.longest]  # what follows changes nothing: it is beyond any term
        if form in self.ordinary or not self._near(form):
            return NONE
        size = self.fuzzy(form)
        return FAR if size >= LENGTHY else NEAR if size else NONE

    def judge(self, word: bytes) -> int:
        """EXACT, FAR, NEAR or NONE. A term behind digits and marks for letters is as a
        misspelled long one. A word of several runs of letters counts as its worst one, and
        single letters with marks between them as one word."""
        plain = word.decode("utf-8", "replace").lower().strip(_AROUND)
        if plain.isalpha():
            return self._letters(plain)
        best = NONE
        for form in dict.fromkeys((plain, plain.translate(_LEET))):
            runs = _LETTERS.findall(form)
            if len(runs) > 2 and all(len(x) == 1 for x in runs):
                runs = ["".join(runs)]
            found = min(filter(None, map(self._letters, runs)), default=NONE)
            if found and form is not plain:
                found = max(found, FAR)
            best = min(filter(None, (best, found)), default=NONE)
        return best


class _Judged(dict):
    """word -> its judgement; two generations bound what is kept, by bytes."""

    ENTRY = 150

    def __init__(self, lexicon: Lexicon, limit: int = 40 << 20):
        super().__init__()
        self.lexicon, self.limit, self.old, self.used = lexicon, limit, {}, 0

    def __missing__(self, word: bytes) -> int:
        if self.used >= self.limit:
            self.old = dict(self)
            self.clear()
            self.used = 0
        v = self.old.get(word)
        self[word] = v = self.lexicon.judge(word) if v is None else v
        self.used += len(word) + self.ENTRY
        return v


Words = tuple[list[str], list[str], list[str]]


def _judged(lexicon: Words) -> _Judged:
    """One for all tasks of a worker."""
    return kept(("judged", *map(tuple, lexicon)), lambda: _Judged(Lexicon(*lexicon)))


def context(words: list[bytes], found: list[int]) -> list[float]:
    """1, then log(1 + n) of exact and far, of far, near, quoted and directed hits, and the
    share of exact and far ones.
    A hit is quoted if quotation marks open before and close after it within the window, or
    a reporting word stands before it; it is directed if the window addresses someone."""
    n = [0, 0, 0, 0, 0]
    for i, v in enumerate(found):
        if v == NONE:
            continue
        before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
        opened = any(w.startswith(OPEN) for w in before) and any(w.rstrip(b".,;:!?").endswith(CLOSE) for w in after)
        near = {w.strip(_EDGE).lower() for w in before[:-1]}
        if opened or near & QUOTING:
            n[3] += 1
        else:
            n[v - 1] += 1
            if (near | {w.strip(_EDGE).lower() for w in after[1:]}) & DIRECT:
                n[4] += 1
    return [1.0, *np.log1p([n[0] + n[1], *n[1:]]).tolist(), min(1.0, 20.0 * (n[0] + n[1]) / max(1, len(words)))]


def features(text: bytes, judged: _Judged) -> list[float]:
    words = text.split()
    return context(words, [judged[w] for w in words])


def _features(column: pa.Array, judged: _Judged) -> np.ndarray:
    """``features`` of each text. Each distinct word is judged once, and only texts with a
    hit are looked at word by word."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    flat = pieces.flatten()
    coded = flat.dictionary_encode()
    found = np.array([judged[w] if w else 0 for w in binary(coded.dictionary)], np.int8)[coded.indices.to_numpy()]
    out = np.zeros((len(column), len(PRIOR)))
    out[:, 0] = 1.0
    owner = np.searchsorted(offsets, np.flatnonzero(found), "right") - 1
    for i in np.unique(owner).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        words = [(w, v) for w, v in zip(binary(flat.slice(a, b - a)), found[a:b].tolist(), strict=True) if w]
        out[i] = context([w for w, _ in words], [v for _, v in words])
    return out


def _signature(words: list[bytes], width: int = 4) -> int:
    """The least hash of its runs of words: near copies mostly share it, others do not."""
    return min((xxhash.xxh3_64_intdigest(b" ".join(words[i : i + width])) >> 1 for i in range(max(1, len(words) - width + 1))), default=0)


def _candidates(least: int, most: int):
    """Of each text: its words (kind 0) and their prefixes (kind 1), each once, and the
    text's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_slice(batches, 200, 1 << 20):
            for text, toxic in zip(binary(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                every = (text or b"").split()
                words = {w.strip(_EDGE).decode("utf-8", "replace").lower() for w in every}
                words = {w for w in words if w.isalpha() and len(w) >= least}
                found = [*((w, 0) for w in words), *((x, 1) for x in {w[:k] for w in words for k in range(least, min(most, len(w)) + 1)})]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32()), pa.array([_signature(every)] * n, pa.int64()), pa.array([int(toxic)] * n, pa.int64())], ["word", "kind", "sig", "toxic"])

    return run


def learn(labelled: DataFrame, least: int = 4, most: int = 12, purity: float = 0.8) -> tuple[list[str], list[str]]:
    """(terms, stems): words, and the shortest prefixes of words, that among the texts of
    ``labelled(text, toxic)`` stand in toxic ones almost alone: at least 4 of them, and 2% of
    them, near copies counted once. So there are at most fifty times the words of a
    toxic text."""
    toxic = labelled.where("toxic = 1").count()
    enough = max(4, -(-2 * toxic // 100))
    once = labelled.mapInArrow(_candidates(least, most), "word string, kind int, sig long, toxic long").groupBy("word", "kind", "sig").agg(F.max("toxic").alias("toxic"))
    counts = once.groupBy("word", "kind").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    pure = counts.where((F.col("t") >= enough) & (F.col("t") >= purity * F.col("n"))).select("word", "kind").collect()
    stems = {r["word"] for r in pure if r["kind"]}
    return sorted(r["word"] for r in pure if not r["kind"]), sorted(s for s in stems if not any(s[:k] in stems for k in range(least, len(s))))


def _fuzzy_hits(lexicon: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Lexicon(*lexicon)
        for batch in per_slice(batches, 200, 1 << 20):
            for text in binary(batch.column("text")):
                runs = {x for w in set((text or b"").split()) for x in _LETTERS.findall(w.decode("utf-8", "replace").lower())}
                found = {x[: of.longest] for x in runs if of._letters(x) in (FAR, NEAR)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    return run


def ordinary_words(clean: DataFrame, lexicon: Words) -> list[str]:
    """Words of ``clean(text)`` that the automaton takes for misspelled terms. They come from
    the bounded sample, and are but those near a term."""
    return sorted(r["word"] for r in clean.mapInArrow(_fuzzy_hits(lexicon), "word string").distinct().collect())


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR; without rows: PRIOR."""
    w = PRIOR.copy()
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * (w - PRIOR))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _featured(lexicon: Words, weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _judged(lexicon)
        for batch in per_slice(batches):
            x = _features(batch.column("text"), judged)
            if weights is None:
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("toxic").cast(pa.int64())], ["x", "toxic"])
            else:
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = 2) -> tuple[Words, np.ndarray]:
    """The lexicon and the weights, from at most ``sample`` rows of ``labels(doc_id, toxic)``
    whose crc32 is not ``held`` mod 4, chosen by hash: two thirds of them yield terms, stems
    and ordinary words, the rest the weights. Null labels are ignored; a doc_id with several
    labels is toxic if one says so; of rows that share one, the least text counts. Without labels the seeds and the prior weights remain."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != held)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    known = staged(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("weigh")), "labelled")
    read = known.where("NOT weigh").select("text", "toxic")
    terms, stems = learn(read)
    terms = sorted({*SEEDS, *terms})
    lexicon = terms, stems, ordinary_words(read.where("toxic = 0").select("text"), (terms, stems, []))
    rows = known.where("weigh").select("text", "toxic").mapInArrow(_featured(lexicon, None), "x array<double>, toxic long").orderBy("x", "toxic").collect()
    return lexicon, fit(np.array([r["x"] for r in rows]).reshape(-1, len(PRIOR)), np.array([r["toxic"] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = 2) -> DataFrame:
    """doc_id, held_out, score for each row of ``docs(doc_id, text)``.

    The lexicon and the weights are learned from a bounded sample (see ``learned``), so they
    are sent to all tasks; all documents are scored, in one pass. Null text: empty, scored
    like any text without terms. Other columns are ignored, rows are independent of each
    other; an empty table gives an empty one.
    """
    lexicon, weights = learned(docs, labels, sample, held)
    read = docs.select("doc_id", "text", (remainder(F.col("doc_id")) == held).alias("held_out"))
    return read.mapInArrow(_featured(lexicon, weights), "doc_id long, held_out boolean, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
