"""Language identification: known words first, character n-grams for the rest.

A word that the training texts have counts with its log frequency in each
language. An unseen word backs off to its character n-grams: the longest
length with a known n-gram decides, down to single characters. A long run of
letters, such as a line of Chinese, counts as pieces of PIECE characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored
from .textkit import NOT_LETTERS, byte_codes, chunks, sums_by_text

#: About so many training texts of each language, chosen by a hash of the id.
MAX_TEXTS = 3_000
#: Words kept of each language, the most frequent ones.
MAX_WORDS = 30_000
NGRAM = 5
#: Characters of a piece of a longer run.
PIECE = 64
UNDETERMINED = "und"
#: Unseen words that a worker remembers; it forgets all when there are more.
MEMORY_WORDS = 200_000


def pieces(run: str) -> list[str]:
    return [run[k : k + PIECE] for k in range(0, len(run), PIECE)]


def ngrams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Backoff:
    """Log probabilities of words and n-grams, a row of languages each."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        """``counts``: how often each (language, word) comes up."""
        self.langs = sorted({lang for lang, _ in counts})
        at = {lang: k for k, lang in enumerate(self.langs)}
        words: dict[str, np.ndarray] = {}
        grams: list[dict[str, np.ndarray]] = [{} for _ in range(NGRAM + 1)]
        for (lang, word), n in counts.items():
            words.setdefault(word, np.zeros(len(at)))[at[lang]] += n
            for size in range(1, NGRAM + 1):
                for g in ngrams(word, size):
                    grams[size].setdefault(g, np.zeros(len(at)))[at[lang]] += n
        self.words, self.word_table = self._log(words)
        self.grams, self.gram_tables = map(list, zip(*(self._log({g: c for g, c in level.items() if c.sum() >= 5}) for level in grams)))
        self.unknown = np.zeros(len(at), np.float32)

    def _log(self, counts: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
        """The row of each name in one table of log probabilities."""
        if not counts:
            return {}, np.zeros((0, len(self.langs)), np.float32)
        table = np.array(list(counts.values())) + 0.1
        return {name: k for k, name in enumerate(counts)}, np.log(table / table.sum(axis=0)).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        """Log probabilities of one word in each language."""
        row = self.words.get(word)
        if row is not None:
            return self.word_table[row]
        for size in range(NGRAM, 0, -1):
            known = [k for g in ngrams(word, size) if (k := self.grams[size].get(g)) is not None]
            if known:
                return self.gram_tables[size][known].mean(axis=0)
        return self.unknown


class Predictor:
    """Applies a Backoff to batches of texts; looks each distinct word of a chunk up once."""

    def __init__(self, model: Backoff):
        self.model, self.rows, self.table = model, {}, np.zeros((1024, len(model.langs)), np.float32)
        self.pieces = np.ones(1024, np.int64)

    def _row(self, key: int, word: str) -> int:
        if len(self.rows) == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.pieces = np.concatenate([self.pieces, np.ones_like(self.pieces)])
        row = self.rows[key] = len(self.rows)
        parts = pieces(word)
        self.table[row] = np.sum([self.model.word(part) for part in parts], axis=0)
        self.pieces[row] = len(parts)
        return row

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        langs = np.array([*self.model.langs, UNDETERMINED], object)
        codes = byte_codes(False)
        lowered = pc.utf8_lower(column)
        for chunk in chunks(lowered):
            starts, ends, first = chunk.runs(NOT_LETTERS)
            if len(self.rows) > MEMORY_WORDS:
                self.rows.clear()
            keys, where, at = np.unique(chunk.hasher(codes)(starts, ends), return_index=True, return_inverse=True)
            data = chunk.data.tobytes()
            rows = np.empty(len(keys), np.int64)
            for k, (key, i) in enumerate(zip(keys.tolist(), where.tolist())):
                row = self.rows.get(key)
                rows[k] = self._row(key, data[starts[i] : ends[i]].decode("utf-8", "replace")) if row is None else row
            values = self.table[rows[at]].astype(np.float64)
            total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)))
            per_text = total[first[1:]] - total[first[:-1]]
            n_words = sums_by_text(self.pieces[rows[at]], first)
            if not self.model.langs:
                best, chance = np.full(chunk.n, -1), np.zeros(chunk.n)
            else:
                best = per_text.argmax(axis=1)
                per_text = per_text / np.maximum(1, n_words / 8)[:, None]  # words are not independent
                chance = 1 / np.exp(per_text - per_text.max(axis=1, keepdims=True)).sum(axis=1)
            ascii_letters = np.concatenate(([0], np.cumsum((chunk.data >= 97) & (chunk.data <= 122))))
            for k in np.flatnonzero(ascii_letters[chunk.offsets[1:]] == ascii_letters[chunk.offsets[:-1]]):
                text = data[chunk.offsets[k] : chunk.offsets[k + 1]].decode("utf-8", "replace")
                if not any(c.isalpha() for c in text):
                    best[k] = -1
            chance[best < 0] = 0.0
            names += langs[best].tolist()
            scores.append(chance)
        return names, np.concatenate(scores) if scores else np.zeros(0)


def train(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS, max_words: int = MAX_WORDS) -> Backoff:
    """Count the words of a bounded sample of labelled texts.

    About ``max_texts`` texts of each language, chosen by a hash of the id,
    are counted whole; ``max_words`` words of each language are kept.
    """
    labelled = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    share = F.pmod(F.xxhash64(F.col("doc").cast("string"), F.lit(7)), F.lit(1_000_000)) / 1_000_000
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (share < max_texts / n))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(False)
        for batch in batches:
            for lang in set(batch.column(0).to_pylist()):
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                for chunk in chunks(pc.utf8_lower(texts)):
                    starts, ends, _ = chunk.runs(NOT_LETTERS)
                    _, where, n = np.unique(chunk.hasher(codes)(starts, ends), return_index=True, return_counts=True)
                    data = chunk.data.tobytes()
                    runs = [pieces(data[a:b].decode("utf-8", "replace")) for a, b in zip(starts[where], ends[where])]
                    words = [part for run in runs for part in run]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(np.repeat(n, [len(run) for run in runs]))], names=["lang", "word", "n"])

    found = labelled.where(chosen).select("lang", "text").mapInArrow(counted, "lang string, word string, n long")
    words = stored(found.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 1"), "words")  # the corpus is read once for all languages
    counts: dict[tuple[str, str], int] = {}
    for lang in sorted(sizes):
        top = words.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(max_words)
        counts |= {(lang, r.word): r.n for r in top.collect()}
    discard(words)
    return Backoff(counts)


def identify(docs: DataFrame, model: Backoff, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``lang_pred`` and ``score``.

    A null text, or one without a letter, gets ``und`` and 0. Of equally likely
    languages the first by name is given. Texts of any length are read whole. Repeated rows
    are predicted each; an empty table gives an empty result. Columns named
    like the new ones are replaced.
    """
    passed = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    rows = docs.select(*dict.fromkeys([*passed, text_col]))
    text_at, passed_at = rows.columns.index(text_col), [rows.columns.index(c) for c in passed]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_WORDS words a language

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            names, scores = predictor.predict(batch.column(text_at))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed_at), pa.array(names, pa.string()), pa.array(scores)], names=[*passed, "lang_pred", "score"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed]
    return rows.mapInArrow(predicted, ", ".join([*fields, "lang_pred string", "score double"]))
