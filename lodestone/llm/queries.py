"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, mixing, pii, quality, rules, simhash, tokens, toxicity, urls, warc
from .common import table

TOKENIZER = "word_bpe_49k.json"
#: The rules that the registered query is asked to apply.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Sources belong to one of four domains; weights are those of children of one node.
DOMAIN_SQL = "'d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS VARCHAR)"
MIX_WEIGHTS = {"domain": {"d0": 1, "d1": 4, "d2": 3, "d3": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, SEED = (3, 5), 3, 42


def with_domain(docs: DataFrame) -> DataFrame:
    """docs with the domain that the number of its source gives; none without a number."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    return docs.withColumn("domain", F.concat(F.lit("d"), (number % 4).cast("string")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    drawn = mixing.draw(docs, weights=MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=SEED, keep_text=False)
    return drawn.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokens.file_of(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks"
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
}

ORACLE: dict[str, str] = {
    "op3_mixing": mixing.oracle("documents", DOMAIN_SQL, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, SEED),
    "op5_warc": warc.ORACLE,
    "op6_url_filter": urls.oracle(URL_RULES),
}
