import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, h binary, n_words long, kept boolean, component_id string, url string"


def table(spark, rows):
    """Documents (doc_id, text, source) with nulls and clashing names in the other columns."""
    return spark.createDataFrame([(d, t, None, s, None, -1, None, None, 7, None, "x", None) for d, t, s in rows], SCHEMA)


WORDS = [f"w{i}" for i in range(400)]
PROSE = " ".join(WORDS[:60])
#: Nulls, empty and white texts, a very long one, ties and repeated rows.
EDGES = [
    (1, PROSE, "a"), (2, None, "a"), (3, "", "b"), (4, " \n\t ", None), (5, PROSE, "b"), (5, PROSE, "b"), (6, "One", "a"), (7, "one", None), (8, " ".join(f"long{i % 977} x{i}" for i in range(60_000)), "c"),
    (9, "Äußerst schön — “quoted” naïve text  with   spaces\n \nand\x1ccontrols İ ŉ", "c"), (10, PROSE + " tail words here", "a"), (11, "the same line\nthe same line\nthe same line\n" + PROSE, "a"), (12, "<|endoftext|> don't we'll 12.5%", None), (None, PROSE, None), (None, None, "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, EDGES).limit(0)


@pytest.fixture(scope="session")
def sf():
    import os

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path
