"""Encoding whole texts with a public tokenizer, word by word through a cache.

The tokenizers library runs once for each word that a worker has not met lately; both
vocabularies never join characters across the cuts made here, so the ids are those of
the whole text (tests compare them). Texts where a cut would not be safe go to the
library as a whole.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: A space between two white-space characters: there the byte-level pattern looks beyond
#: the space, so such texts are not cut. Last bytes and first bytes of white space in UTF-8.
_UNSAFE = re.compile(rb"(?:^|[\t-\r \x85\xa0\x80-\x8a\xa8\xa9\xaf\x9f]) (?:$|[\t-\r \xc2\xe1-\xe3])")
#: What can stand at the end of such a place: a quick test.
_BEFORE = [b" " + bytes([c]) for c in (*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3)]
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class _Ids(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers. Two generations bound it:
    when the young one has ``limit`` bytes it becomes the old one, from which pieces in use
    come back."""

    #: What an entry takes beside the bytes of its piece and ids.
    ENTRY = 180

    def __init__(self, encode, limit: int, empty: bytes):
        super().__init__({b"": empty})
        self.encode, self.limit, self.empty, self.old, self.tails = encode, limit, empty, {}, {}
        self.counted, self.used = 1, 0

    def of(self, pieces: list[bytes], whole) -> list[bytes]:
        if self.used > self.limit:
            self.old = dict(self)
            self.clear()
            self[b""] = self.empty
            self.counted, self.used = 1, 0
        if len(self.tails) > 20_000:
            self.tails.clear()
        self._learn(pieces, whole)
        out = list(map(self.__getitem__, pieces))
        # What was learned just now is taken to be as long as this batch's pieces are.
        self.used += (len(self) - self.counted) * (self.ENTRY + (sum(map(len, pieces)) + sum(map(len, out))) // max(1, len(pieces)))
        self.counted = len(self)
        return out

    def _missing(self, pieces) -> list[bytes]:
        new, old = [x for x in pieces if x not in self], self.old
        if not old:
            return new
        out = []
        for x in new:
            if (ids := old.get(x)) is None:
                out.append(x)
            else:
                self[x] = ids
        return out

    def _learn(self, pieces: list[bytes], whole) -> None:
        # A run of ASCII marks after an ASCII letter or digit is a piece of its own.
        cut, new = [], []
        for x in self._missing(pieces):
            stem = x.rstrip(_MARKS)
            if stem is not x and len(stem) != len(x) and stem and stem[-1] in _ALNUM:
                cut.append((x, stem, x[len(stem) :]))
            else:
                new.append(x)
        for tail in {tail for _, _, tail in cut}.difference(self.tails):
            self.tails[tail] = whole(tail)
        self.encode(self, list({*new, *self._missing({stem for _, stem, _ in cut})}))
        self.update((x, self[stem] + self.tails[tail]) for x, stem, tail in cut)


class Encoder:
    """kind "words": vocabularies that drop white space and never join words; the last token
    of a run of letters ends with </w>. kind "bytes": byte-level vocabularies, where a word
    takes the space before it as Ġ. ``end`` is appended to each document. Strings of special
    tokens in a text become those tokens, as the library has it; texts that hold one go to
    it as a whole."""

    def __init__(self, vocabulary: str, kind: str, end: int, limit: int = 40 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.encode_special_tokens = True  # for pieces, which hold none: lower-casing must not make one
        self.special = re.compile(b"|".join(sorted((re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)) or b"(?!)")
        self.kind, self.end, self.inner = kind, end, _Ids(self._encode_pieces, limit, b"" if kind == "words" else self.whole(b" "))
        self.edge = np.zeros(self.library.get_vocab_size(), bool)  # tokens at a piece's end, or start
        for token, i in self.library.get_vocab().items():
            self.edge[i] = token.endswith("</w>") if kind == "words" else token.startswith("Ġ")

    def _encode_pieces(self, known: dict[bytes, bytes], pieces: list[bytes]) -> None:
        """Encodes pieces, each with a space before it, many in one text: those of letters
        alone have one edge token, and the others are cut where tokens' places cross."""
        letters, others = [], []
        for x in pieces:  # bytes.isalpha: ASCII letters alone
            if x.isalpha() or ((t := x.decode("utf-8", "replace")).isalpha() and max(t) < "\u0180" and "İ" not in t):
                letters.append(x)
            else:
                others.append((x, t))
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast([(b" " + b" ".join(part)).decode()], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            self._cut(known, part, edges[:-1] + 1 if self.kind == "words" else edges[1:], ids)
        for at in range(0, len(others), 1000):
            part = others[at : at + 1000]
            found = self.library.encode(" " + " ".join(t for _, t in part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for _, t in part[:-1]])
            places = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
            self._cut(known, [p for p, _ in part], np.searchsorted(places, starts[1:]), np.array(found.ids, "<u4"))

    def _cut(self, known: dict[bytes, bytes], pieces: list[bytes], cuts: np.ndarray, ids: np.ndarray) -> None:
        if len(cuts) != len(pieces) - 1:  # not cut where expected: each piece by itself
            known.update((x, self.whole(b" " + x)) for x in pieces)
            return
        data, at = ids.tobytes(), 0
        for piece, cut in zip(pieces, [*(cuts * 4).tolist(), len(data)], strict=True):
            known[piece] = data[at:cut]
            at = cut

    def whole(self, text: bytes) -> bytes:
        found = self.library.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)
        return np.array(found[0].ids, "<u4").tobytes()

    def _with_special(self, text: bytes) -> bytes:
        self.library.encode_special_tokens = False
        try:
            return self.whole(text)
        finally:
            self.library.encode_special_tokens = True

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, how many each has). Null: empty. Each
        distinct word of the column is looked up once."""
        texts, docs, own = pc.fill_null(column, ""), len(column), []
        raw = texts.cast(pa.binary()).to_pylist()
        special = [self.special.search(x) is not None for x in raw]
        if self.kind == "words":
            if any(special):
                own = [self._with_special(x) if bad else b"" for x, bad in zip(raw, special, strict=True)]
                texts = pc.if_else(pa.array(special, pa.bool_()), "", texts)
            pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:  # what stands before the first space, or an unsafe text as a whole, is encoded by itself
            unsafe = [bad or (x.endswith(b" ") or any(b in x for b in _BEFORE)) and bool(_UNSAFE.search(x)) for x, bad in zip(raw, special, strict=True)]
            own = [self._with_special(x) if odd else self.whole(x if bad else x.split(b" ", 1)[0]) for x, bad, odd in zip(raw, unsafe, special, strict=True)]
            pieces = pc.split_pattern(pc.if_else(pa.array(unsafe, pa.bool_()), "", texts), " ")
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = pieces.flatten().dictionary_encode()
        table = [*self.inner.of(coded.dictionary.cast(pa.binary()).to_pylist(), self.whole), np.array([self.end], "<u4").tobytes(), *own]
        codes = coded.indices.to_numpy().astype(np.int64)
        n = len(table) - len(own)
        if own:
            to = np.flatnonzero(special) if self.kind == "words" else np.arange(docs)
            codes[offsets[:-1][to]] = n + to
        all_codes = np.full(len(codes) + docs, n - 1)  # the end id after each document
        all_codes[np.arange(len(codes)) + np.repeat(np.arange(docs), np.diff(offsets))] = codes
        flat = np.frombuffer(b"".join(table), "<u4")
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        size = sizes[all_codes]
        ends = np.cumsum(size)
        # Steps through ``flat``: by one within a piece, else to the next piece's start.
        some = all_codes[size > 0]
        begin, count = (np.cumsum(sizes) - sizes)[some], sizes[some]
        steps = np.ones(int(ends[-1]) if docs else 0, np.int32)
        steps[np.cumsum(count) - count] = begin - np.concatenate([[0], (begin + count - 1)[:-1]])
        ids = flat[np.cumsum(steps, dtype=np.int32)]
        last = ends[offsets[1:] + np.arange(docs)] if docs else ends
        return ids, np.diff(last, prepend=0)


def encoder(vocabulary: str, kind: str, end: int) -> Encoder:
    """One for all tasks of a worker, which so keep what they have learned."""
    return kept(("encoder", vocabulary, kind, end), lambda: Encoder(vocabulary, kind, end))


def vocabulary(path: str) -> str:
    """The vocabulary file's text; the driver reads it once and sends it along."""
    return Path(path).read_text(encoding="utf-8")
