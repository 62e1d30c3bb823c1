"""Host-level quality rules.

Rules are checked for each document; their failures are summed by host, and
each host's failure rate is shrunk towards the mean of all hosts with a beta
prior whose strength comes from the spread between hosts. A host whose shrunk
rate for any rule is far out in that prior is rejected, and that verdict is
joined back to its documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join
from .scratch import stored
from .textkit import BLANKS, Chunk, byte_codes, byte_set, chunks, mix, owner, sums_by_text

SYMBOLS = byte_set(b"#*$%&|<>")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 8


def text_features(chunk: Chunk) -> dict[str, np.ndarray]:
    """Counts for each text of a chunk."""
    starts, ends, first = chunk.runs(BLANKS)
    data, at = chunk.data, chunk.offsets
    solid = ~BLANKS[data]
    solid_before = np.concatenate(([0], np.cumsum(solid)))
    chars_before = np.concatenate(([0], np.cumsum(solid & ((data & 0xC0) != 0x80))))
    symbols_before = np.concatenate(([0], np.cumsum(SYMBOLS[data])))

    spans = chunk.hasher(byte_codes(False))
    line_starts, line_ends, first_line = chunk.lines()
    worded = solid_before[line_ends] > solid_before[line_starts]
    repeated = np.zeros(len(line_starts), bool)
    where = np.flatnonzero(worded)
    with np.errstate(over="ignore"):
        keys = mix(spans(line_starts[where], line_ends[where]) + owner(first_line)[where].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    repeated[where[order[1:][keys[order[1:]] == keys[order[:-1]]]]] = True

    return {
        "n_words": np.diff(first),
        "word_chars": chars_before[at[1:]] - chars_before[at[:-1]],
        "n_symbols": symbols_before[at[1:]] - symbols_before[at[:-1]],
        "n_dup_lines": sums_by_text(repeated, first_line),
        "n_repeat_words": sums_by_text(_in_repeated_window(spans(starts, ends), first), first),
        "n_lines": sums_by_text(worded, first_line),
    }


def _in_repeated_window(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, whether it is in a window of WINDOW words that its text has twice."""
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        text = owner(first)
        whole = np.flatnonzero(text[: len(words) - WINDOW + 1] == text[WINDOW - 1 :])
        with np.errstate(over="ignore"):
            keys = text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(WINDOW):
                keys = keys * np.uint64(0xD6E8FEB86659FD93) + words[whole + k]
            keys = mix(keys)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, whole[twice], 1)
        np.add.at(covered, whole[twice] + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_features(c) for c in chunks(batch.column(2))]
        columns = [pa.array(np.concatenate([f[name] for f in found]) if found else [], pa.int64()) for name in FEATURES]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "host", *FEATURES])


def beta_prior(rates: DataFrame, rule: str) -> tuple[float, float]:
    """The two parameters of the beta prior of a rule's failure rate, by moments over hosts.

    With one host, or hosts that all have the same rate, the strength is at
    its upper limit of 1000 documents.
    """
    r = rates.agg(
        (F.sum(rule) / F.sum("docs")).alias("mean"),
        F.coalesce(F.var_samp(F.col(rule) / F.col("docs")), F.lit(0.0)).alias("var"),
        F.avg(1 / F.col("docs")).alias("per_doc"),
    ).first()
    mean = min(max(r.mean or 0.0, 1e-4), 1 - 1e-4)
    between = max((r.var or 0.0) - mean * (1 - mean) * (r.per_doc or 0.0), 1e-9)  # without the noise of small hosts
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def score_hosts(
    docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_rate: float = 0.2, max_rate: float = 0.5, deviations: float = 3.0, max_symbols: float = 0.3, max_dup_lines: float = 0.5
) -> DataFrame:
    """Features, base verdict, host failure rates and final verdict for each row of ``docs``.

    Rules: ``short`` (under 20 words), ``repeats`` (over 30 in 100 words are in
    repeated windows), ``symbols`` (over ``max_symbols`` symbols a word),
    ``dup_lines`` (over that share of lines repeat an earlier one). A document
    is dropped if it fails one of the first two, or if its host's shrunk rate
    of any rule is above the limit of the rule: ``deviations`` standard
    deviations above the mean of the fitted prior, but neither under
    ``min_rate`` nor over ``max_rate``.

    Null or blank texts have no words and fail ``short``; a null host counts
    as the host ''; repeated rows are judged and returned each; an empty
    table gives an empty result; other columns are ignored. Texts of any length
    are read whole; a rate that equals a limit is within it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_col).alias("doc"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, host string, " + ", ".join(f"{name} long" for name in FEATURES)
    rules = {
        "short": F.col("n_words") < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": F.col("n_symbols") > max_symbols * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > max_dup_lines * F.col("n_lines"),
    }
    features = stored(rows.mapInArrow(_feature_batches, schema).withColumns({k: v for k, v in rules.items()}), "rules")
    hosts = stored(features.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(F.col(k).cast("long")).alias(k) for k in rules)), "hosts")
    shrunk, over = {}, F.lit(False)
    for rule in rules:
        a, b = beta_prior(hosts, rule)
        shrunk[f"host_{rule}_rate"] = (F.col(rule) + F.lit(a)) / (F.col("docs") + F.lit(a + b))
        mean = a / (a + b)
        limit = min(max(mean + deviations * math.sqrt(mean * (1 - mean) / (a + b + 1)), min_rate), max_rate)
        over = over | (shrunk[f"host_{rule}_rate"] > limit)
    verdicts = stored(hosts.select("host", *(v.alias(k) for k, v in shrunk.items()), over.alias("host_rejected")), "verdicts")
    base_failed = F.col("short") | F.col("repeats")
    return (
        lookup_join(features, verdicts, "host")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .withColumnRenamed("doc", doc_col)
    )
