"""Quality rules as a ledger of failure bits, with policies that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, fresh, let, named, others, staged

SPAN = 8
#: name -> failure, over the measurements. The place in this list is the rule's bit; rules
#: are only ever appended, so that old ledgers stay readable.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_spans", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
]
BASE = ("few_words", "repeated_spans")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "2024-1": (*BASE, "symbols", "repeated_lines"), "2024-2": tuple(name for name, _ in RULES)}
POLICY = "2024-2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def bits(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _repeated(hashes: Column) -> Column:
    """How many words stand in spans of SPAN words that occur twice or more. Spans are
    compared by the hash of their words' hashes; only texts with an equal pair sort them."""
    spans = F.transform(F.sequence(F.lit(0), F.size(hashes) - SPAN), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(SPAN)]))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        same = lambda all_, e, j: (F.get(all_, j)["h"] == e["h"])
        twice = let(pairs, lambda a: F.filter(a, lambda e, j: F.coalesce(same(a, e, j - 1), F.lit(False)) | F.coalesce(same(a, e, j + 1), F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda e: e["p"]))
        new = let(places, lambda a: F.transform(a, lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get(a, k + 1) - p, F.lit(SPAN)))))
        return F.aggregate(new, F.lit(0), lambda x, y: x + y)

    return F.when(F.size(hashes) <= SPAN, F.lit(0)).otherwise(let(spans, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and ``failure_bits``: one scan, no exchange. Each
    rule is evaluated once; policies only read the bits.

    Null or empty text: no words, so few_words fails. Columns of docs that carry one of the
    ledger's names, in whatever case, are replaced; all others are kept. Rows are independent
    of each other; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.concat_ws("", w)).alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    kept = others(docs, *MEASURES, "failure_bits")
    w, l, n = fresh(docs, "by_word", "by_line", "symbols")
    measured = docs.select(*kept, count.alias(w), by_line.alias(l), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias(n)).select(
        *kept,
        *[named(of)[name].cast("long").alias(name) for of, name in ((w, "n_words"), (w, "word_chars"))], named(n).cast("long").alias("n_symbols"),
        *[named(of)[name].cast("long").alias(name) for of, name in ((l, "n_dup_lines"), (w, "n_repeat_words"), (l, "n_lines"))],
    )
    failed = [F.when(F.expr(failure), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, failure) in enumerate(RULES)]
    out = failed[0]
    for one in failed[1:]:
        out = out.bitwiseOR(one)
    return measured.withColumn("failure_bits", out.cast("long"))


def keeps(policy: str = POLICY) -> Column:
    """True for ledger rows that the policy keeps."""
    return F.col("failure_bits").bitwiseAND(bits(POLICIES[policy])) == 0


def ablation(of: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that only it rejects, and the
    rows kept without it. Rows are first counted by their bits, of which there are few."""
    mask = bits(POLICIES[policy])
    counts = of.groupBy(F.col("failure_bits").bitwiseAND(mask).alias("b")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bits((name,))).alias("bit")) for name in POLICIES[policy]])).alias("r")
    return counts.select("b", "count", rules).groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("count"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("count"))), F.lit(0)).alias("only_this"),
        F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("count"))), F.lit(0)).alias("kept_without"),
        F.bit_or("b").alias("bits_seen"),
    )


def only_rule(policy: str = POLICY) -> Column:
    """Of ledger rows that one rule of the policy alone rejects, that rule; else empty."""
    failed = F.col("failure_bits").bitwiseAND(bits(POLICIES[policy]))
    return F.coalesce(*[F.when(failed == bits((name,)), F.lit(name)) for name in POLICIES[policy]], F.lit(""))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written once. Policies of two versions and the ablation read it: for a
    document that one rule alone rejects, that rule and how many documents it so rejects."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = staged(ledger(docs).drop("text"), "ledger")
    base = F.col("failure_bits").bitwiseAND(bits(BASE)) != 0
    judged = written.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), keeps().alias("kept"), "failure_bits", keeps("2024-1").alias("kept_2024_1"), only_rule().alias("only_rule"))
    effects = ablation(written).select(F.col("rule").alias("only_rule"), F.col("only_this").alias("n_only_rule"))
    return judged.join(F.broadcast(effects), "only_rule", "left").withColumn("n_only_rule", F.coalesce("n_only_rule", F.lit(0)))  # a row for each rule is broadcast


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
n AS (SELECT *, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM m),
f AS (SELECT *, (n_words < 20) AS f0, (100 * n_repeat_words > 30 * n_words) AS f1, (10 * n_symbols > n_words) AS f2, (100 * n_dup_lines > 30 * n_lines) AS f3, (word_chars < 2 * n_words) AS f4, (word_chars > 12 * n_words) AS f5 FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f0 OR f1) AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept,
       CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT AS BIGINT) AS failure_bits,
       NOT (f0 OR f1 OR f2 OR f3) AS kept_2024_1,
       CASE failure_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_spans' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' ELSE '' END AS only_rule,
       CASE WHEN failure_bits IN (1, 2, 4, 8, 16, 32) THEN CAST(count(*) OVER (PARTITION BY failure_bits) AS BIGINT) ELSE 0 END AS n_only_rule
FROM f
"""
