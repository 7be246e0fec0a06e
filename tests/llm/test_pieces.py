import hashlib
import random

import numpy as np
import pytest

from forgelens.llm import pieces

from .conftest import EDGES, table

public = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", " \n", "a\nb", "a \n b", "▁", "a▁b", "▁a", " ▁ a", "\x00", "a\x00b", "naïve İ ŉ 中文 벨 ゼ 梦 😀 x😀y", "<s> </s> <0x41> <unk>", "\t\ta", "    " * 20 + "x",
    " a", "aaaa" * 100, "abc" * 500 + " d", "ab\r\ncd", "▁▁▁\n▁", "x" * 200 + "\n" + "y" * 200, "  　 é é", "é中😀" * 120,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(open(PATH, "rb").read())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def same(coder, library, texts):
    got = [ids(x) for x in coder.of([t.encode() for t in texts])]
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert [coder.model.decode(g) for g in got] == library.decode(want)


def test_odd_texts(coder, library):
    same(coder, library, ODD)
    assert coder.of([None])[0] == coder.of([b""])[0]


def test_random_texts(coder, library):
    """Letters at random, and pieces side by side, where many splits compete."""
    rng = random.Random(5)
    letters, known = "abcdefghijklmnopqrstuvwxyz ▁\n  ABCéßñ0123456789.,😀中", list(coder.model.known)
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    some += ["".join(rng.choice(known) for _ in range(rng.randint(1, 8))) for _ in range(10_000)]
    same(coder, library, some + ["".join(rng.choice("ersthn ai") for _ in range(rng.randint(150, 400))) for _ in range(200)])


def test_long_pieces_agree_with_short_ones(coder):
    rng = random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice("abcdefinorst▁é😀") for _ in range(150))
        assert coder.model._encode_long(text) == coder.model.encode([text])[0]


def test_pair_test_is_the_encoding_of_both(coder, library):
    """Two pieces are compatible exactly if the library leaves them as they are; its own
    space sign, which it adds before a text, is taken away by a first piece of spaces."""
    rng, model = random.Random(7), coder.model
    names = {i: p for p, i in model.known.items()}
    some = [i for i in names if names[i].startswith(pieces.SPACE) and names[i] != pieces.SPACE and model.alone[i]]
    rest = [i for i in names if not names[i].startswith(pieces.SPACE) and model.alone[i]]
    pairs = [(rng.choice(some), rng.choice(rest)) for _ in range(4000)]
    got = model.compatible(*(np.array(x) for x in zip(*pairs, strict=True)))
    for (a, b), good in zip(pairs, got, strict=True):
        text = (names[a] + names[b]).replace(pieces.SPACE, " ")
        assert good == (library.encode(text[1:]) == [a, b]), text


def test_generations_bound_the_cache(library):
    small = pieces.Encoder(open(PATH, "rb").read(), limit=20_000)
    texts = [" ".join(f"w{i * j % 997}" for j in range(60)) for i in range(300)]
    for at in range(0, 300, 20):
        same(small, library, texts[at : at + 20])
        assert len(small.young) + len(small.old) < 1500


def test_decode_of_any_ids(coder, library):
    rng = random.Random(8)
    rows = [[rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    rows += [[222, 2, 150], [1, 222, 150, 2], [0], []]
    assert [coder.model.decode(r) for r in rows] == library.decode(rows)


def test_long_text(coder, library):
    """One run of 200,000 characters, and 100,000 words."""
    rng = random.Random(9)
    same(coder, library, ["".join(rng.choice("abcdef0123456789") for _ in range(200_000)), " ".join(f"word{i}" for i in range(100_000))])


def test_edges(edges, nothing, library):
    got = pieces.decode_documents(pieces.encode_documents(edges, PATH), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(d, library.encode(t or "", add_bos=True, add_eos=True)) for d, t, _ in EDGES]
    assert sorted([(r.doc_id, ids(r.ids), r.text) for r in got], key=key) == sorted([(d, w, library.decode(w)) for d, w in want], key=key)
    assert pieces.decode_documents(pieces.encode_documents(nothing, PATH), PATH).count() == 0


def test_other_models_are_an_error():
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto.FromString(open(PATH, "rb").read())
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.Pieces(m.SerializeToString())


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op11_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
