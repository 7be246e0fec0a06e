"""Extra columns with the names that the operators add or use inside, in whatever case."""

import public_tokenizers
import pytest

from forgelens.llm import fingerprints, mixing, near_dup, packing, quality, secrets, substrings, token_files, toxicity, url_rules

NAMES = ["_w", "_s", "_l", "N_WORDS", "Failure_Bits", "by_word", "By_Line", "symbols", "_limit", "_source", "_base", "Size", "Copies", "TARGET", "of_source", "Source_Sum", "own_size", "copy", "base", "Base_Spans", "base_found",
         "run_text", "_best", "_stack", "_host", "Host", "Path", "RULE", "page_host", "Found_Host", "best", "_place", "_at", "next_text", "print", "Node", "component", "kept", "row", "sha", "packed", "h", "held_out", "toxic", "x", "a.b", "q`q"]
TEXT = "You are an idiot with token = abcdef123456 and " + " ".join(f"w{i}" for i in range(40))


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(d, TEXT + f" {d % 3}", "s", *(f"{n}{d}" for n in NAMES)) for d in range(6)]
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in ("text", "source", *NAMES))
    return spark.createDataFrame(rows, f"doc_id long, {fields}")


def passed(out, new):
    """The columns that no new name replaces come through with their values."""
    kept = [n for n in NAMES if n.lower() not in new]
    assert all(n in out.columns for n in kept)
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in kept)


def test_columns_pass(clash, spark):
    passed(quality.ledger(clash), {*quality.MEASURES, "failure_bits"})
    passed(mixing.mix(clash), {"size", "source_size", "target", "copies"})
    passed(mixing.take(clash), set())
    passed(secrets.scan(clash, *secrets.calibrated(secrets.samples(spark, 300))), {"base_spans", "secret_spans"})
    pages = clash.withColumn("URL_", secrets.F.concat(secrets.F.lit("http://www.example.com/en/"), "doc_id"))
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    out = url_rules.judge(pages, rules, 3, url="URL_")
    passed(out, {"host", "path", "rule", "verdict"})
    assert {r.rule for r in out.select("rule").collect()} == {"www.example.com/en/"}


def test_columns_are_ignored(clash, spark):
    assert near_dup.near_duplicates(clash).count() == substrings.repeated_words(clash).count() == fingerprints.fingerprint_edits(clash, graded=True).count() == 6
    assert packing.pack_documents(clash, public_tokenizers.path("byte_bpe_50k.json")).count() == 6
    assert token_files.token_index(token_files.write_token_files(clash, None, public_tokenizers.path("word_bpe_49k.json"), "words", 1, 2)).count() == 6
    assert toxicity.score(clash, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 6
