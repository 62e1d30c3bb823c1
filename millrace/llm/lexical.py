"""Ranked lexical search over postings in buckets of terms.

Each text becomes a row for each of its different terms, with its frequency;
postings are stored in folders by a hash of the term, each folder dealt by
documents besides, as one term may be in most texts. A search reads the
buckets, joins the terms of its items, scores every match with integers, sums
by item and document where a document's matches are gathered, and numbers the
best of each item in a window that keeps few rows a task before its shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import checked_broadcast, lookup_join
from .scratch import small_batches, stored
from .textkit import plain_words, text_bytes

#: Folders of postings, by terms; each is written by so many tasks, by documents.
BUCKETS = 64
SLICES = 8
#: The bucket of the rows that hold a document's number of terms.
LENGTHS = -1


def _posting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its number of terms, and lists of its different terms and how often each comes up."""
    for batch in batches:
        sizes, terms, times, ends = [], [], [], [0]
        for text in text_bytes(batch.column(2)):
            found: Counter[bytes] = Counter()
            for words in plain_words(text):
                found.update(words)
            sizes.append(found.total())
            terms += found.keys()
            times += found.values()
            ends.append(len(terms))
        offsets = pa.array(np.array(ends, np.int32))
        lists = (pa.ListArray.from_arrays(offsets, x) for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], names=["row", "doc", "n", "terms", "times"])


def _counted(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, ``doc``, ``n``, ``terms`` and ``times`` of each text; ``row`` tells rows of one id apart."""
    kind = rows.schema[id_col].dataType.simpleString()
    named = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return named.mapInArrow(_posting_batches, f"row long, doc {kind}, n long, terms array<string>, times array<bigint>")


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A stored table of ``item``, ``term`` and ``times``, repeats in an item's text; rows of one id are one item."""
    with small_batches(items.sparkSession):
        pairs = _counted(items, item_col, text_col).select(F.col("doc").alias("item"), F.explode(F.arrays_zip("terms", "times")).alias("t"))
        return stored(pairs.groupBy("item", F.col("t.terms").alias("term")).agg(F.sum("t.times").alias("times")), "item-terms")


def postings(docs: DataFrame, vocabulary: DataFrame | None = None, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of ``term``, ``row``, ``doc``, ``times`` and ``n`` (terms of the document), in folders by ``bucket``; and a row without a term for each document in bucket LENGTHS.

    ``vocabulary`` (``term``) leaves out terms that it doesn't hold, for searches whose items are known.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        counted = _counted(docs, doc_col, text_col)
        entry = F.explode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "terms").alias("term"), F.concat(F.array(F.lit(0).cast("long")), "times").alias("times")))
        rows = counted.select("row", "doc", "n", entry.alias("e")).select("row", "doc", "n", F.col("e.term").alias("term"), F.col("e.times").alias("times"))
        if vocabulary is not None:
            known = stored(vocabulary.select("term").distinct().withColumn("known", F.lit(True)), "vocabulary")
            rows = lookup_join(rows, known, "term", "left").where("term is null or known").drop("known")
        bucket = F.when(F.col("term").isNull(), F.lit(LENGTHS)).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
        dealt = rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(SLICES)))
        return stored(dealt, "postings", by=("bucket",))


def search(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", doc_col: str = "doc_id") -> DataFrame:
    """``item_col``, ``rank``, ``doc_col`` and ``score`` of each item's ``k`` documents of highest score above 0, equal scores by ascending id; ``items`` are ``item_terms``, ``index`` are ``postings``."""
    total = index.where(F.col("bucket") == LENGTHS).agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.docs, max(1, total.terms or 0)
    vocabulary = stored(items.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    hits = lookup_join(index.where(F.col("bucket") != LENGTHS), vocabulary, "term")
    df = hits.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = stored(df.select("term_id", weight.alias("w")).where("w > 0"), "weights")  # 0 adds nothing; df <= N, so none is negative

    m = F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L")
    gain = F.expr("w * ((1000000000L * times) div (1000L * times + 12L * m))")
    scored = lookup_join(hits, weights, "term_id").withColumn("m", m).select("term_id", "row", "doc", gain.alias("gain"))
    gathered = scored.repartition("row")
    asked = items.join(vocabulary, "term").select("term_id", "item", F.col("times").alias("asked"))
    matches = gathered.join(checked_broadcast(stored(asked, "asked")), "term_id")
    sums = matches.groupBy("item", "row", "doc").agg(F.sum(F.col("gain") * F.col("asked")).alias("score")).where("score > 0")
    best = W.partitionBy("item").orderBy(F.desc("score"), "doc", "row")
    ranked = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(doc_col), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``search`` of all ``items`` in all ``docs``.

    Terms are the runs of other characters than ASCII signs and blanks, with A-Z
    lower-cased. A text that is null, empty or without terms is found by
    nothing and counts as no document; such an item finds nothing. Texts of any
    length are read whole, in pieces. Of equal scores the lesser id comes
    first, null before others, and rows of one id are documents each. Items of
    one id are one item. An empty table on either side gives an empty result;
    other columns aren't looked at.
    """
    terms = item_terms(items, item_col, text_col)
    return search(postings(docs, terms, doc_col, text_col), terms, k, item_col, doc_col)
