"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over the distinct words, and prefixes of words, of a text is
trained in numpy from confirmed toxic examples and unlabelled text. Its risk
is that of Kiryo et al. (2017): with the class prior p, the loss of positives
as positive has weight p, and the loss of unlabelled texts as negative is
corrected by p times the loss of positives as negative; where that difference
becomes negative, the step goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .textkit import NOT_LETTERS, Chunk, byte_codes, chunks, mix, owner

#: At most about so many confirmed toxic and unlabelled texts are trained on.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
#: Features are the words and prefixes that set positives apart most; at most so many.
MAX_FEATURES = 2_048
PREFIXES = (5, 6, 7)
LEVELS = (1, 2, 3, 5)


def text_items(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, item) pairs of a chunk.

    Items are hashes: of each word, and of each prefix together with the
    number of LEVELS that the text's distinct words with it reach.
    """
    starts, ends, first = chunk.runs(NOT_LETTERS)
    spans = chunk.hasher(byte_codes(True))
    text = owner(first)
    words = spans(starts, ends)
    _, at = np.unique(words ^ mix(text.astype(np.uint64)), return_index=True)  # each distinct word of a text once
    starts, ends, text = starts[at], ends[at], text[at]
    texts, items = [text], [words[at]]
    for n in PREFIXES:
        longer = ends - starts > n
        prefix, of = spans(starts[longer], starts[longer] + n), text[longer]
        _, at, times = np.unique(prefix ^ mix(of.astype(np.uint64)), return_index=True, return_counts=True)
        for level in LEVELS:
            enough = at[times >= level]
            texts.append(of[enough])
            items.append(mix(prefix[enough] + np.uint64(16 * n + level)))
    return np.concatenate(texts), np.concatenate(items)


def _folded(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


@dataclass
class Classifier:
    """Sorted item hashes with their weights, and the bias."""

    items: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """The chance of label 1 for each text; a text without a known item gets that of the bias."""
        out = []
        few = np.zeros(1 << 16, bool)
        few[(self.items & np.uint64(0xFFFF)).astype(np.int64)] = True
        for chunk in chunks(_folded(column)):
            text, items = text_items(chunk)
            maybe = np.flatnonzero(few[(items & np.uint64(0xFFFF)).astype(np.int64)])
            text, items = text[maybe], items[maybe]
            at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1) if len(self.items) else np.zeros(0, np.int64)
            known = self.items[at] == items if len(self.items) else np.zeros(0, bool)
            text = text[known] if len(self.items) else text[:0]
            out.append(self.bias + np.bincount(text, self.weights[at[known]], chunk.n))
        margin = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def class_prior(examples: DataFrame, label: str) -> float:
    """The share of positives among the labelled examples, within 0.001 and 0.5."""
    share = examples.agg(F.avg((F.col(label) == 1).cast("double")).alias("share")).first().share
    return min(max(share or 0.0, 1e-3), 0.5)


def select_features(sample: DataFrame, max_features: int = MAX_FEATURES) -> np.ndarray:
    """Item hashes whose document frequency in positives is far above that in unlabelled texts.

    ``sample`` has ``text``, ``positive`` and ``unlabelled``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2)]
            found = []
            for chunk in chunks(_folded(batch.column(0))):
                text, items = text_items(chunk)
                found.append((items, *(f[chunk.first + text] for f in flags)))
            items, positive, unlabelled = (np.concatenate(f) for f in zip(*found))
            names, where = np.unique(items, return_inverse=True)
            p, u = (np.bincount(where, of, len(names)).astype(np.int64) for of in (positive, unlabelled))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(p), pa.array(u)], names=["item", "p", "u"])

    n = sample.agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")).first()
    if not n.p or not n.u:
        return np.zeros(0, np.uint64)
    rate_p, rate_u = F.col("p") / n.p, F.col("u") / n.u
    both = (F.col("p") + F.col("u")) / (n.p + n.u)
    z = (rate_p - rate_u) / F.sqrt(both * (1 - both) * (1 / n.p + 1 / n.u) + F.lit(1e-12))
    best = (
        sample.select("text", "positive", "unlabelled")
        .mapInArrow(counted, "item long, p long, u long")
        .groupBy("item")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .where((F.col("p") >= 3) & (rate_p > 2 * rate_u))
        .withColumn("z", z)
        .where("z > 4")
        .orderBy(F.desc("z"), "item")
        .limit(max_features)
        .collect()
    )
    return np.sort(np.array([r.item for r in best], np.int64).view(np.uint64))


def fit_nnpu(rows: list[tuple[np.ndarray, bool]], n_features: int, prior: float, steps: int = 1500, rate: float = 0.05, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk; rows are (feature indexes, positive)."""
    sizes = np.array([len(f) for f, _ in rows])
    feature = np.concatenate([f for f, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    positive = np.array([p for _, p in rows], bool)
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        margin = theta[-1] + np.bincount(row, theta[feature], len(rows))
        sigmoid = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        softplus = np.logaddexp(0, margin)
        negative_risk = softplus[~positive].sum() / n_u - prior * softplus[positive].sum() / n_p
        slope = np.zeros(len(rows))
        if negative_risk >= 0:
            slope[positive] = prior * (sigmoid[positive] - 1) / n_p - prior * sigmoid[positive] / n_p
            slope[~positive] = sigmoid[~positive] / n_u
        else:
            slope[positive] = prior * sigmoid[positive] / n_p
            slope[~positive] = -sigmoid[~positive] / n_u
        gradient = np.append(np.bincount(feature, slope[row], n_features), slope.sum()) + ridge * np.append(theta[:-1], 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Classifier:
    """Fit on confirmed toxic texts and unlabelled ones; the caller leaves out rows that must not be learnt from.

    Both classes are bounded samples by a hash of the id: about
    ``max_positive`` and ``max_unlabelled`` texts. Without a positive, the
    classifier has no features and scores every text by the prior.
    """
    labels = labels.select(F.col(doc_col).alias("doc"), F.col(label_col).alias("label")).where("doc is not null and label is not null").groupBy("doc").agg(F.max("label").alias("label"))
    prior = class_prior(labels, "label")
    n_positive, n_docs = labels.where("label = 1").count(), docs.count()
    if not n_positive or not n_docs:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    share = F.pmod(F.xxhash64(F.col("doc").cast("string")), F.lit(1_000_000)) / 1_000_000
    toxic = labels.where("label = 1").where(share < max_positive / n_positive).select("doc", F.lit(True).alias("positive"))
    texts = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    sample = (
        texts.join(F.broadcast(toxic), "doc", "left")  # bounded by max_positive
        .select("text", F.coalesce("positive", F.lit(False)).alias("positive"), (share < max_unlabelled / n_docs).alias("unlabelled"))
        .where("positive or unlabelled")
    )
    sample = stored(sample, "toxic-sample")
    items = select_features(sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for chunk in chunks(_folded(batch.column(0))):
                text, found = text_items(chunk)
                at = np.minimum(np.searchsorted(items, found), len(items) - 1)
                known = items[at] == found
                order = np.argsort(text[known], kind="stable")
                lists += np.split(at[known][order].astype(np.int32), np.searchsorted(text[known][order], np.arange(1, chunk.n)))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["features", "positive", "unlabelled"])

    if not len(items):
        return Classifier(items, np.zeros(0), float(np.log(prior / (1 - prior))))
    rows = sample.mapInArrow(featured, "features array<int>, positive boolean, unlabelled boolean").collect()
    weights, bias = fit_nnpu([(np.array(r.features, np.int64), flag) for r in rows for flag, is_so in ((True, r.positive), (False, r.unlabelled)) if is_so], len(items), prior)
    return Classifier(items, weights, bias)


def score(docs: DataFrame, model: Classifier, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """The columns ``keep`` (the others by default, and the text) with ``score`` and ``predicted``.

    A null or empty text is scored too; texts of any length are read whole;
    repeated rows are scored each, equal texts alike; a score that equals the
    threshold is predicted; an empty table gives an empty result. Columns named
    like the new ones are replaced.
    """
    passed = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    rows = docs.select(*dict.fromkeys([*passed, text_col]))
    text_at, passed_at = rows.columns.index(text_col), [rows.columns.index(c) for c in passed]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = model.scores(batch.column(text_at))
            columns = [*(batch.column(k) for k in passed_at), pa.array(chance), pa.array((chance >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, "score", "predicted"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed]
    return rows.mapInArrow(scored, ", ".join([*fields, "score double", "predicted int"]))
