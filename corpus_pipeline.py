"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.llm import mixing, near_dup, packing, quality, secrets
from forgelens.llm.common import staged

#: The end id of each packed document, and the length of a sequence.
END, CAPACITY = 2, 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. Null texts have no words, so they go; rows
    are judged each by itself, whatever doc_id they have."""
    return quality.ledger(docs).where(quality.keeps()).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a likeness of 0.8: the one
    with the least doc_id. Rows that share a doc_id are one document, of which the row with
    the least text stays; rows without doc_id are in no group. The ids that stay meet the
    documents in a join of partitions at every size; only the ids are hashed."""
    judged = staged(near_dup.near_duplicates(docs, 5, 80), "judged").where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count()
    kept = docs.join(judged.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    if not judged.where("count > 1").isEmpty():
        rest = [c for c in docs.columns if c != "doc_id"]
        kept = kept.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("r")).select("doc_id", "r.*").select(docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced, and n_chars follows. Null texts
    stay null."""
    clean = secrets.redact(F.col("text"), F.col("secret_spans"))
    found = secrets.scan(docs, *secrets.calibrated(secrets.samples(spark))).withColumn("text", clean)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them. A null source is a
    source; rows that share a doc_id are taken alike; texts without words are of no size and
    are taken as often as their source is taken whole."""
    return mixing.take(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. A null text is its end id alone;
    rows that share a doc_id are packed each by itself."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "bytes", END, CAPACITY)


STAGES = [(f.__name__, f) for f in (quality_rules, near_duplicates, secret_scan, source_mix, best_fit_packing)]
#: SQL cannot express the stages (tokenizer, models, packing); a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep; an empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
