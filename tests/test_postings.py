"""The maintained index: as a scan of the texts, after any change."""

import pytest
from pyspark.sql import functions as F

from forgelens.operators import postings, retrieval

QUERIES = ["tion", "the queue", "aaaa", "Retry Queue", "100%", "x y", "", "数据处理引擎", "zzz nowhere", "ing ing", "que queue"]
ROWS = [
    (1, "Retry queue", "the function retries the queue"), (2, "aaaaaaaaa", None), (3, None, "notion of the nation: tion tion"), (4, "", ""), (5, "ab", "x"), (6, "分布式数据处理引擎", "一个数据处理引擎"), (7, "que", "ue the queue"),
    (8, "İstanbul QUEUE", "100% the queue"), (9, "the", "queue"),
]


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, description string")


@pytest.fixture
def index(spark, tmp_path):
    return postings.Index.create(texts(spark, ROWS), f"file://{tmp_path}/index", ["name", "description"], buckets=8)


def same(spark, index, rows):
    """Scores and order of each query as those of a scan."""
    df, met = texts(spark, rows), 0
    for q in QUERIES:
        want = retrieval.match(df, ["name", "description"], q).select("id", F.round("bm25", 9), F.round("relevance", 9)).collect()
        got = index.match(q).select("id", F.round("bm25", 9), F.round("relevance", 9)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), q
        met += len(want)
        best = sorted(want, key=lambda r: (-r[1], r[0]))[:2]
        assert [r.id for r in index.top(q, 2).collect()] == [r.id for r in best], q
    return met


def test_as_a_scan(spark, index):
    assert same(spark, index, ROWS) > 8 and index.texts() == len(ROWS)


def test_changes(spark, index):
    rows = {r[0]: r for r in ROWS}
    changed = [(3, "tion", "the queue again"), (2, "aaa", "aaaa"), (20, "new queue", "tion"), (4, None, None)]
    index.sync(texts(spark, changed), spark.createDataFrame([(1,), (99,)], "id long"))
    rows |= {r[0]: r for r in changed}
    del rows[1]
    same(spark, index, list(rows.values()))
    index.sync(removed=spark.createDataFrame([(20,)], "id long"))
    index.sync(texts(spark, [(1, "back", "the retry queue")]))
    del rows[20]
    rows[1] = (1, "back", "the retry queue")
    same(spark, index, list(rows.values()))
    index.compact()
    assert len(index.entry()["generations"]) == 1 and index.texts() == len(rows)
    same(spark, index, list(rows.values()))
    index.sync(removed=texts(spark, list(rows.values())).select("id"))
    assert index.texts() == 0 and same(spark, index, []) == 0


def test_only_asked_folders_are_read(spark, index):
    plan = index.match("queue")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan
    files = index.postings(["que"]).inputFiles()
    assert files and {f.rsplit("/", 2)[1] for f in files} == {f"bucket={postings.zlib.crc32(b'que') % 8}"}


def test_a_change_in_between_is_an_error(spark, index, monkeypatch):
    other = postings.Index(spark, index.path)
    real = postings.lengths

    def late(*args):
        monkeypatch.setattr(postings, "lengths", real)
        other.sync(removed=spark.createDataFrame([(9,)], "id long"))
        return real(*args)

    monkeypatch.setattr(postings, "lengths", late)
    with pytest.raises(RuntimeError):
        index.sync(texts(spark, [(50, "lost", "queue")]))
    same(spark, index, [r for r in ROWS if r[0] != 9])


def test_text_ids_and_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "some queue"), ("b", "other")], "key string, text string")
    index = postings.Index.create(rows, f"file://{tmp_path}/t", ["text"], "key")
    assert [r.id for r in index.match("queue").collect()] == ["a"]
    empty = postings.Index.create(rows.limit(0), f"file://{tmp_path}/e", ["text"], "key")
    assert empty.match("queue").count() == 0
    empty.sync(rows)
    assert [r.id for r in empty.match("queue").collect()] == ["a"]
    again = postings.Index.create(rows.limit(0), f"file://{tmp_path}/e", ["text"], "key")
    assert again.texts() == 2


def test_long_text_in_time(spark, tmp_path):
    """A million characters: trigrams cost in proportion to them."""
    rows = spark.range(1).select("id", F.repeat(F.lit("some words of a text, "), 45_000).alias("text"))
    index = postings.Index.create(rows, f"file://{tmp_path}/t", ["text"])
    assert index.match("words text").count() == 1


def test_a_row_for_a_block(spark, tmp_path):
    """Stored rows grow with the trigrams of a block, not with each text's."""
    rows = spark.range(3000).select("id", F.concat(F.lit("the same words again "), F.col("id").cast("string")).alias("text"))
    index = postings.Index.create(rows.coalesce(1), f"file://{tmp_path}/t", ["text"])
    stored = spark.read.parquet(f"{index.path}/{index.entry()['generations'][0]['folder']}/postings")
    assert stored.count() < 10_000 < index.postings(["the", "wor", "ain"]).count() + 1001
    assert index.match("words again").count() == 3000


def test_many_letters_and_blocks(spark, monkeypatch):
    """Trigrams of tens of thousands of letters, and of texts in several blocks, as by hand."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    texts = [None, "", "ab", "\0\0\0\0", *["".join(chr(rng.choice([rng.randrange(32, 40), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(3000))) for _ in range(40)]]
    want = {}
    for i, t in enumerate(texts):
        for p in range(len(t or "") - 2):
            want.setdefault((t[p : p + 3], i), []).append(p)
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "length": pa.array([len(t or "") for t in texts], pa.int32()), "t": texts})
    for size in (1 << 30, 20_000):
        monkeypatch.setattr(postings, "BLOCK", size)
        got, cut = {}, list(postings._cut(batch, ["t"]))
        assert sum(b.num_rows for b in cut) == len(texts) and (len(cut) > 3) == (size < 1 << 30)
        for b in cut:
            for r in postings._block(b["id"], b["length"], b["t"], 0).to_pylist():
                for i, x in enumerate(r["ids"]):
                    got[r["gram"], x] = r["at"][r["ends"][i - 1] if i else 0 : r["ends"][i]]
                    assert r["lengths"][i] == len(texts[x])
        assert got == want
