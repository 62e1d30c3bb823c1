"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, jaccard_join, language_id, lexical, license_scan, merkle, oracles, quality_rules, sharding, simhash, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.score_hosts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(fold("doc_id", 3) != 1), labels.where(fold("doc_id", 3) != 1))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold("doc_id", 5) != 0))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents"), n_shards=40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), shingle=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), shingle=3, budget=2)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(fold("doc_id", 5) == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), claims={"text": tampered})


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def quality_of_unlike_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules where hosts differ, so that some lose all their documents."""
    docs = spark.sql(oracles.UNLIKE_HOSTS.replace("FROM documents", "FROM {t}"), t=table(spark, sf_dir, "documents"))
    judged = quality_rules.score_hosts(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def jaccard_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other documents each one links to."""
    return jaccard_join.link_counts(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_license_scan": op2_license_scan,
        "op3_bpe": op3_bpe,
        "op4_decontamination": op4_decontamination,
        "op5_toxicity": op5_toxicity,
        "op6_language_id": op6_language_id,
        "op7_url_filter": op7_url_filter,
        "op8_sharding": op8_sharding,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_chat_format": op10_chat_format,
        "op11_simhash": op11_simhash,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_lexical_search": op13_lexical_search,
        "quality_of_unlike_hosts": quality_of_unlike_hosts,
        "jaccard_link_counts": jaccard_link_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracles.QUALITY_RULES,
        "op4_decontamination": oracles.DECONTAMINATION,
        "op9_jaccard_join": oracles.JACCARD_JOIN,
        "op10_chat_format": chat_format.ORACLE_SQL,
        "op12_merkle_manifest": oracles.MERKLE_MANIFEST,
        "op13_lexical_search": oracles.LEXICAL_SEARCH,
        "quality_of_unlike_hosts": oracles.QUALITY_OF_UNLIKE_HOSTS,
        "jaccard_link_counts": oracles.LINK_COUNTS,
    }
