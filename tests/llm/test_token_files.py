import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from forgelens.llm import token_files, tokens

from .conftest import EDGES

PATHS = {"words": public_tokenizers.path("word_bpe_49k.json"), "bytes": public_tokenizers.path("byte_bpe_50k.json")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=3000))
def test_round_trip(ids):
    ids = np.array(ids, "<u4")
    words, offsets = token_files.encode(ids)
    assert (token_files.decode(words, offsets, len(ids)) == ids).all()


def test_caches_are_bounded_by_bytes():
    import pyarrow as pa

    encoder = tokens.Encoder(tokens.vocabulary(PATHS["words"]), "words", 3, limit=100_000)
    library = Tokenizer.from_file(PATHS["words"])
    for k in range(30):
        texts = [" ".join(f"{c}{k}{i}{'long' * (i % 9)}" for i in range(200)) for c in "ab"]
        ids, _ = encoder(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 3]]
        assert len(encoder.inner) < 1500 and len(encoder.inner.old) < 1500


def test_words_are_packed():
    words, offsets = token_files.encode(np.zeros(1024, "<u4"))
    assert len(words) == 18 and len(offsets) == 1


@pytest.mark.parametrize("kind", ["words", "bytes"])
@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ é \n\t .,'!0İß́<|>"), max_size=30), max_size=6))
def test_encoder_is_the_library(kind, texts):
    import pyarrow as pa

    encoder = _encoder(kind)
    ids, lengths = encoder(pa.array(texts, pa.string()))
    library = Tokenizer.from_file(PATHS[kind])
    want = [[*library.encode(t, add_special_tokens=False).ids, 3] for t in texts]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


_known = {}


def _encoder(kind):
    if kind not in _known:
        _known[kind] = tokens.Encoder(tokens.vocabulary(PATHS[kind]), kind, 3, limit=5000)
    return _known[kind]


def brute(rows):
    library = Tokenizer.from_file(PATHS["words"])
    at, out = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_files(spark, edges, nothing, tmp_path):
    segments = token_files.write_token_files(edges, str(tmp_path / "ids"), PATHS["words"], "words", 1, 3, per_segment=2)
    assert sorted(map(tuple, token_files.token_index(segments).collect()), key=str) == brute(EDGES)
    assert token_files.token_index(token_files.write_token_files(nothing, None, PATHS["words"], "words", 1, 3)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, token_files.op1_token_files(spark, sf).collect()), key=str) == brute(rows)


def test_shards_grow_with_the_input(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert token_files.shards_for(docs) == token_files.shards_for(spark.range(3)) == 2 * token_files.partitions_for(spark)
    monkeypatch.setattr(token_files, "PER_SHARD", 1000)
    assert token_files.shards_for(docs) > 50
