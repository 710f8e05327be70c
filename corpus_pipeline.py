"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and is written
as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, mixing, pii, quality, queries, simhash
from lodestone.llm.common import labelled_sample, packed, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from all of documents' labels."""
    sample = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 3, 1, 4000)
    scored = quality.score_documents(docs.select(packed(docs), "text"), quality.train(sample))
    return scored.where("score >= 0.5").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that domains, languages and sources meet their weights."""
    named = queries.with_domain(docs)
    return mixing.draw(named, weights=queries.MIX_WEIGHTS, share=queries.MIX_SHARE, max_epochs=queries.MIX_EPOCHS, seed=queries.SEED)


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("pii redaction", redact),
    ("mixing", mix),
]

#: Hashing, trained models and fingerprints have no SQL form; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
