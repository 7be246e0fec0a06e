"""SentencePiece BPE by a table of prefixes, and its decoding.

Of greedy merging two things hold. Where a text's encoding has a boundary, no merge ever
crossed it, so both sides encode as they do alone; and a sequence of tokens is an encoding
exactly if each two neighbours, encoded together, stay as they are (the first merge that
crosses a boundary would cross it in that pair alone, too). So each prefix of a text has one
last token: of the tokens that an automaton finds to end there, the one that is compatible
with the last token of the prefix before it. The table of last tokens is filled from left to
right, and read backwards from its end.

Two tokens are tested by the merges that each goes through alone: the next merge of the
left, of the right, and of what stands at the boundary, whichever has the highest score,
the leftmost first. All pieces of a slice that a worker has not met lately go through the
automaton and the tests side by side.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import binary, kept, per_slice

SPACE = "▁"
#: No score: below all scores.
NONE = -(1 << 31)
#: Pieces of more characters go through the automaton one by one, as side by side they would
#: all wait for the longest.
LONG = 192
#: Slots of the memory of tested pairs.
SLOTS = 1 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """The tables of a model, from its file's bytes. Models of other kinds, and those that
    rewrite texts or have pieces of users' own, are an error."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto.FromString(model)
        rule, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        if m.trainer_spec.model_type != proto.TrainerSpec.BPE or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a BPE model with bytes for unknown characters")
        if rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a model that rewrites texts, or has pieces of another kind")
        self.bos, self.eos = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        self.size = len(m.pieces)
        self.other = self.size  # stands for each character that no piece is made of
        self.byte_ids = np.array([i for _, i in sorted((int(p.piece[3:-1], 16), i) for i, p in enumerate(m.pieces) if p.type == BYTE)], np.int64)
        self.known = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.score = {i: int(m.pieces[i].score) for i in self.known.values()}
        if any(self.score[i] != m.pieces[i].score for i in self.known.values()) or len(self.byte_ids) != 256:
            raise ValueError("scores that are no integers, or not one piece for each byte")
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for p in self.known for c in p}))}
        if any(c not in self.known for c in self.alphabet) or any(SPACE in p.lstrip(SPACE) for p in self.known) or "\n" in self.alphabet:
            raise ValueError("pieces that join words or lines, or lack one of their characters")
        self._merges()
        self._automaton()
        self._surfaces(m.pieces, m.trainer_spec.unk_surface)
        self.tested = np.full(SLOTS, -1, np.int64)
        self.by_key: dict[int, int] | None = None  # the automaton's moves, made when the first long text comes

    def _merges(self) -> None:
        """For each piece alone: the scores of its merges in order, and the first and last
        symbol after each; whether it ends as itself. And the scores of all joins of two."""
        known, score = self.known, self.score
        width = max(map(len, known)) + 1
        self.steps = np.full((self.size + 1, width), NONE, np.int64)
        self.first = np.full((self.size + 1, width), self.other, np.int64)
        self.last = np.full((self.size + 1, width), self.other, np.int64)
        self.alone = np.zeros(self.size + 1, bool)
        self.alone[self.other] = True
        joins = {}
        for piece, i in known.items():
            parts, k = list(piece), 0
            for cut in range(1, len(piece)):
                a, b = known.get(piece[:cut]), known.get(piece[cut:])
                if a is not None and b is not None:
                    joins[a * (self.size + 1) + b] = score[i]
            while True:
                self.first[i, k:], self.last[i, k:] = known[parts[0]], known[parts[-1]]
                best, at = NONE, -1
                for j in range(len(parts) - 1):
                    s = score.get(known.get(parts[j] + parts[j + 1], -1), NONE)
                    if s > best:
                        best, at = s, j
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                self.steps[i, k] = best
                k += 1
            self.alone[i] = len(parts) == 1
        self.joins = np.array(sorted(joins), np.int64)
        self.join_scores = np.array([joins[j] for j in self.joins.tolist()], np.int64)

    def _automaton(self) -> None:
        """States are the prefixes of pieces; each knows the longest piece that ends there,
        and each piece the longest shorter one that ends with it."""
        grown: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, i in self.known.items():
            at = 0
            for c in piece:
                step = self.alphabet[c]
                if step not in grown[at]:
                    grown[at][step] = len(grown)
                    grown.append({})
                    ends.append(-1)
                at = grown[at][step]
            ends[at] = i
        fall, found = [0] * len(grown), list(ends)
        self.shorter = np.full(self.size + 1, -1, np.int64)
        queue = deque(grown[0].values())
        while queue:
            at = queue.popleft()
            below = found[fall[at]] if fall[at] else -1
            if ends[at] >= 0:
                self.shorter[ends[at]] = below
            else:
                found[at] = below
            for c, to in grown[at].items():
                back = fall[at]
                while c not in grown[back] and back:
                    back = fall[back]
                fall[to] = grown[back].get(c, 0)
                queue.append(to)
        letters = len(self.alphabet) + 1
        pairs = sorted((at * letters + c, to) for at, step in enumerate(grown) for c, to in step.items())
        self.letters, self.moves, self.to = letters, np.array([k for k, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64)
        self.fall, self.found = np.array(fall, np.int64), np.array(found, np.int64)
        self.length = np.ones(self.size + 1, np.int64)
        for piece, i in self.known.items():
            self.length[i] = len(piece)
        self.code = np.zeros(0x110000, np.int16 if letters < 1 << 15 else np.int32)
        for c, i in self.alphabet.items():
            self.code[ord(c)] = i

    def _surfaces(self, pieces, unknown: str) -> None:
        self.surface, self.is_byte = [], [p.type == BYTE for p in pieces]
        for i, p in enumerate(pieces):
            self.surface.append(bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else unknown.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.is_control = [p.type == CONTROL for p in pieces]
        self.controls = {i for i, p in enumerate(pieces) if p.type == CONTROL}
        self.leads = [p.type == NORMAL and p.piece.startswith(SPACE) for p in pieces]

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        return np.where(self.joins[at] == key, self.join_scores[at], NONE)

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b, encoded together, stay as they are."""
        good, live = np.ones(len(a), bool), np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            x, y, m, n = a[live], b[live], i[live], j[live]
            left, right, cross = self.steps[x, m], self.steps[y, n], self._join(self.last[x, m], self.first[y, n])
            met = (cross > left) & (cross >= right)
            good[live[met]] = False
            go = ~met & (np.maximum(left, right) > NONE)
            by_left = left >= right
            i[live[go & by_left]] += 1
            j[live[go & ~by_left]] += 1
            live = live[go]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_test``, with a memory of as many pairs as there are slots."""
        key = a * (self.size + 1) + b
        slot = ((key * 0x9E3779B1) >> 7) & (SLOTS - 1)
        entry = self.tested[slot]
        new = np.flatnonzero(entry >> 1 != key)
        if len(new):
            keys = np.unique(key[new])
            good = self._test(keys // (self.size + 1), keys % (self.size + 1))
            self.tested[((keys * 0x9E3779B1) >> 7) & (SLOTS - 1)] = keys * 2 + good
            entry[new] = good[np.searchsorted(keys, key[new])]
        return (entry & 1).astype(bool)

    def _move(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out, at, live = np.zeros(len(state), np.int64), state.copy(), np.flatnonzero(letter)
        while len(live):
            key = at[live] * self.letters + letter[live]
            place = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            hit = self.moves[place] == key
            out[live[hit]] = self.to[place[hit]]
            live = live[~hit & (at[live] > 0)]
            at[live] = self.fall[at[live]]
        return out

    def last_tokens(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The table: for each character the last token of the prefix that ends there. Texts
        lie in ``points`` and come by falling length; none is empty."""
        table, letters = np.full(len(points), -1, np.int64), self.code[points].astype(np.int64)
        state = np.zeros(len(starts), np.int64)
        for p in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -p, "left"))  # texts of more than p characters
            here = starts[:n] + p
            state[:n] = self._move(state[:n], letters[here])
            token = np.where(letters[here] == 0, self.other, self.found[state[:n]])
            live = np.arange(n)
            while len(live):
                now = token[live]
                before = p - self.length[now]
                good = self.alone[now]
                inner = np.flatnonzero((before >= 0) & good)
                last = table[starts[live[inner]] + before[inner]]
                good[inner] = self.compatible(last, now[inner])
                table[here[live[good]]] = now[good]
                live = live[~good]
                token[live] = self.shorter[token[live]]
        return table

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, as it is, its ids as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        many = [i for i in order if len(texts[i]) <= LONG]
        for i in order[: len(order) - len(many)]:
            out[i] = self._encode_long(texts[i])
        if not many:
            return out
        points = np.frombuffer("".join([texts[i] for i in many]).encode("utf-32-le"), "<u4")
        lengths = np.fromiter((len(texts[i]) for i in many), np.int64, len(many))
        starts = np.cumsum(lengths) - lengths
        table = self.last_tokens(points, starts, lengths)
        # Backwards: the last token of all, then that of the prefix before it.
        chosen, at, live = np.zeros(len(points), bool), lengths - 1, np.arange(len(many))
        while len(live):
            here = starts[live] + at[live]
            chosen[here] = True
            at[live] -= self.length[table[here]]
            live = live[at[live] >= 0]
        places = np.flatnonzero(chosen)
        ids, counts = self._ids(table[places], points[places])
        ends = np.cumsum(np.add.reduceat(counts, np.searchsorted(places, starts))) * 4
        data, begin = ids.tobytes(), 0
        for i, end in zip(many, ends.tolist(), strict=True):
            out[i] = data[begin:end]
            begin = end
        return out

    def _ids(self, tokens: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each token): a character of no piece becomes its bytes."""
        odd = np.flatnonzero(tokens == self.other)
        counts = np.ones(len(tokens), np.int64)
        raw = [chr(c).encode("utf-8", "replace") for c in points[odd].tolist()]
        counts[odd] = [len(b) for b in raw]
        ids = np.repeat(tokens, counts)
        if len(odd):
            first = (np.cumsum(counts) - counts)[odd]
            to = np.repeat(first, counts[odd]) + np.concatenate([np.arange(len(b)) for b in raw])
            ids[to] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids.astype("<u4"), counts

    def _encode_long(self, text: str) -> bytes:
        """The same for one long text, character by character."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        table, state = np.full(len(points), self.other, np.int64), 0
        if self.by_key is None:
            self.by_key = dict(zip(self.moves.tolist(), self.to.tolist(), strict=True))
        moves, pairs = self.by_key, {}
        letters, found, length, shorter, alone, fall = (x.tolist() for x in (self.code[points], self.found, self.length, self.shorter, self.alone, self.fall))
        for p, c in enumerate(letters):
            token = self.other
            if c:
                while (to := moves.get(state * self.letters + c)) is None and state:
                    state = fall[state]
                state = to or 0
                token = found[state]
            else:
                state = 0
            while True:
                before = p - length[token]
                good = alone[token]
                if good and before >= 0:
                    pair = (int(table[before]), token)
                    if (good := pairs.get(pair)) is None:
                        good = pairs[pair] = bool(self.compatible(np.array([pair[0]]), np.array([token]))[0])
                if good:
                    break
                token = shorter[token]
            table[p] = token
        chosen, at = [], len(points) - 1
        while at >= 0:
            chosen.append(at)
            at -= length[table[at]]
        places = np.array(chosen[::-1], np.int64)
        return self._ids(table[places], points[places])[0].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library gives it: the first space goes, control ids are
        nothing, bytes that are no UTF-8 become U+FFFD each."""
        head = next((i for i in ids if not self.is_control[i]), None)
        cut = 1 if head is not None and self.leads[head] else 0
        if not self.controls.isdisjoint(ids[1:-1]):  # bytes on both sides of one are two characters
            return self._decode_bytes(ids)[cut:]
        try:
            return b"".join(map(self.surface.__getitem__, ids))[cut:].decode()
        except UnicodeDecodeError:
            return self._decode_bytes(ids)[cut:]

    def _decode_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if _is_character(run[:n])), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


#: Texts with other spaces than one between two words, or with the sign that stands for one.
_ODD = re.compile(rb"^ | $|  |^\n| \n|\xe2\x96\x81")
_PARTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")


class Encoder:
    """Whole texts, piece by piece: no token holds a space sign after another character, nor
    a line feed, so no merge crosses a place before one. Two generations of pieces met
    lately are kept, each of up to ``limit`` bytes."""

    #: What an entry takes beside the bytes of its piece and ids.
    ENTRY = 180

    def __init__(self, model: bytes, limit: int = 32 << 20):
        self.model, self.limit = Pieces(model), limit
        self.young, self.old, self.used = {}, {}, 0
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos, self.model.eos))

    @staticmethod
    def parts(text: bytes) -> list[bytes]:
        """The pieces of a text. One that begins with a line feed or a space sign is as it
        stands, others have a space sign before them."""
        if not text:
            return []
        if _ODD.search(text):
            # The first piece begins with the space sign; runs after it, as they stand.
            return [p.encode() for p in _PARTS.findall(SPACE + text.decode("utf-8", "replace").replace(" ", SPACE))]
        return text.replace(b"\n", b" \n").split(b" ")

    def of(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, begin and end included. Null: empty."""
        cut = [self.parts(t or b"") for t in texts]
        if self.used > self.limit:
            self.young, self.old, self.used = {}, self.young, 0
        young, old, new = self.young, self.old, []
        for p in set().union(*cut):
            if p not in young:
                if (ids := old.get(p)) is None:
                    new.append(p)
                else:
                    young[p] = ids
                    self.used += self.ENTRY + len(p) + len(ids)
        mark = SPACE.encode()
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            found = self.model.encode([(p if p[:1] == b"\n" or p.startswith(mark) else mark + p).decode("utf-8", "replace") for p in some])
            young.update(zip(some, found, strict=True))
            self.used += sum(map(len, some)) + sum(map(len, found)) + self.ENTRY * len(some)
        return [self.begin + b"".join(map(young.__getitem__, parts)) + self.end for parts in cut]


def _coded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(("pieces", hash(model)), lambda: Encoder(model))
        for batch in per_slice(batches):
            ids = coder.of(binary(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids of each row of ``docs(doc_id, text)``: ids is binary, little-endian
    unsigned 32-bit integers, with the model's begin and end ids.

    Null or empty text: those two alone. Rows are independent of each other, whatever their
    doc_id, nothing is exchanged; other columns are ignored. An empty table has no rows.
    A worker holds a slice of 4 MB, or one longer text, with its ids, and bounded caches.
    """
    model = Path(model_path).read_bytes()
    return docs.select("doc_id", "text").mapInArrow(_coded(model), "doc_id long, ids binary")


def _decoded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(("pieces", hash(model)), lambda: Encoder(model))
        for batch in per_slice(batches):
            texts = [None if ids is None else coder.model.decode(np.frombuffer(ids, "<u4").tolist()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode_documents(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text of each row of ``coded(doc_id, ids)``. Null ids: null."""
    model = Path(model_path).read_bytes()
    return coded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, ids binary, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("ids").to_pylist(), binary(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), *[pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, texts)]],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = Path(path).read_bytes()
    code, decode = _coded(model), _decoded(model)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # encode_documents, decode_documents and the digest in one worker, which holds the tables once.
    return docs.mapInArrow(lambda batches: _digest(decode(code(batches))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
