"""A training-corpus pipeline over ``documents``: language, toxicity, near duplicates, benchmark passages, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard_join, language_id, toxicity
from millrace.llm.queries import fold, table
from millrace.llm.scratch import stored

MIN_LANGUAGE_SCORE = 0.5


#: Columns that stages look at; all others are passed on under names that no operator uses.
USED = ("doc_id", "text", "lang", "source")


def _shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with other names for the columns that are only passed on, and what gives a result its columns and names back."""
    names = [c if c in USED else f"passed_on_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda kept: kept.select(*names).toDF(*docs.columns)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found with some confidence.

    A text that is null or has no letter has none and goes. Repeated rows and
    rows without an id are judged each; texts of any length are read whole.
    """
    rows, restored = _shielded(docs)
    model = language_id.train(rows.where(fold("doc_id", 5) != 0))
    found = language_id.identify(rows, model, keep=rows.columns)
    return restored(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier does not call toxic.

    Null and empty texts are scored like any other. Repeated rows and rows
    without an id are judged each; texts of any length are read whole.
    """
    rows, restored = _shielded(docs)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    model = toxicity.train(rows.where(fold("doc_id", 3) != 1), labels)
    return restored(toxicity.score(rows, model, keep=rows.columns).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked ones, of the least id that isn't null: shingles of five words, a similarity of 0.8 or more.

    Of rows with one id and text the first by position stays. Texts that are
    null or have no words are linked with nothing and stay; texts of any length
    are read whole.
    """
    rows, restored = _shielded(docs)
    keyed = stored(rows.withColumn("row_key", F.monotonically_increasing_id()), "keyed")  # ids may be null or repeated
    found = jaccard_join.components(keyed, doc_col="row_key", shingle=5, percent=80).select("row_key", "component_id")
    groups = stored(found.join(keyed.select("row_key", "doc_id"), "row_key"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    kept = groups.groupBy("component_id").agg(first.alias("first")).select("first.row_key")
    copies = groups.select("row_key").join(kept, "row_key", "left_anti")
    return restored(keyed.join(copies, "row_key", "left_anti"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a window of a benchmark item.

    Null and wordless texts have none and stay. Rows are told apart by id and
    text, so repeated rows share a verdict; texts of any length are read whole.
    """
    rows, restored = _shielded(docs)
    hits = decontaminate.find_overlaps(rows, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("hit_id"), "text_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("text_hash"))  # ids may be null or repeated
    return restored(rows.join(hits, same, "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left, a row for each; a null text counts as empty, and texts of any length are encoded whole."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", detect_language),
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("bpe", encode),
]

#: Trained models and tokenizing can't be said in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
