"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words that the corpus has most often are encoded once and compiled into
an automaton that shares prefixes and suffixes; the numbers on its arcs add up
to a word's rank, which leads to its ids. The automaton is a flat file that
every worker maps into memory. Texts are cut into words with numpy, the
different words of a chunk walk the automaton together, and those that it lacks
are merged exactly, all of one length at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import claimed, discard, shared_dir, stored
from .textkit import slices

#: Words in the lexicon; all others are merged when they come up.
LEXICON_WORDS = 60_000
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 400_000
#: Longer words, in bytes, are not in the lexicon, and are merged with a heap.
LONG_WORD = 64
#: Characters that are cut into words at once; a longer text is divided at blanks.
CHUNK_CHARS = 1 << 21

# In these characters, the rules below are those of the tokenizer file; other texts go through its own normalizer and splitter.
_USUAL_END = 0x2028
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-\u0239\u023b-\u023d\u023f-\u024f\u2010-\u2027]")
_FRACTIONS = "²³¹¼½¾"
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
#: What a word may begin with after an apostrophe that no sign stands before.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_CUT = re.compile("[ \t\n\r]")


def _kinds() -> np.ndarray:
    """Blank, letter, digit or other for each usual character."""
    return np.array([_BLANK if c.isspace() else _DIGIT if c in "0123456789" + _FRACTIONS else _LETTER if unicodedata.category(c)[0] == "L" else _OTHER for c in map(chr, range(_USUAL_END))], np.uint8)


_KINDS = _kinds()
_CODES = np.random.default_rng(49_408).integers(1 << 63, size=_USUAL_END, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each of several spans, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def cut_words(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a usual, lower-cased text, given as code points."""
    kind = _KINDS[chars]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    quotes = starts[(chars[starts] == 39) & (ends - starts == 1)]
    if len(quotes):
        tail = np.full((3, len(quotes)), 32, chars.dtype)
        for k in (1, 2):
            inside = quotes + k < len(chars)
            tail[k][inside] = chars[quotes[inside] + k]
        length = np.zeros(len(quotes), np.int64)
        for ending in _ENDINGS:
            same = tail[1] == ord(ending[0])
            if len(ending) == 2:
                same &= tail[2] == ord(ending[1])
            length[same] = len(ending)
        quotes, length = quotes[length > 0], length[length > 0]
        new[quotes + 1] = False  # the letters belong to the apostrophe, what is left of their run stands alone
        after = quotes + 1 + length
        after = after[after < len(new)]
        new[after] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(kind))
    word = kind[starts] != _BLANK
    return starts[word], ends[word]


def word_names(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words of one hash are compared later."""
    names, length = np.zeros(len(starts), np.uint64), ends - starts
    active, k = np.arange(len(starts)), 0
    with np.errstate(over="ignore"):
        while len(active) and k < LONG_WORD:
            names[active] = (names[active] ^ _CODES[chars[starts[active] + k]]) * np.uint64(0x9E3779B97F4A7C15)
            names[active] ^= names[active] >> np.uint64(29)
            k += 1
            active = active[length[active] > k]
    text = chars.tobytes() if len(active) else b""
    for w in active:  # long words
        names[w] = int.from_bytes(hashlib.blake2b(text[4 * starts[w] : 4 * ends[w]], digest_size=8).digest(), "little")
    return names


def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Model:
    """Vocabulary, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"].get("end_of_word_suffix") or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {tuple(m): k for k, m in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.letters = byte_letters()
        self.bytes_of = {self.letters[b]: b for b in range(256)}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path = path
        self._pair_tables()

    @cached_property
    def library(self) -> Tokenizer:
        """Its own reader of the file, for unusual texts."""
        return Tokenizer.from_file(self.path)

    def library_words(self, text: str) -> list[bytes]:
        """The words of an unusual text without special tokens."""
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.bytes_of[c] for c in word]) for word, _ in split]

    def parts(self, text: str) -> list[str]:
        """Plain text and special tokens in turn, plain text first and last."""
        return self.split_special.split(text) if self.split_special and "<|" in text else [text]

    def _pair_tables(self) -> None:
        """Merges as sorted keys with ranks and results, and all merges of two bytes as a dense table."""
        ids, n = self.vocab, len(self.ranks)
        left, right, merged = (np.array([ids[x] for x in column], np.int64) for column in ([p[0] for p in self.ranks], [p[1] for p in self.ranks], [p[0] + p[1] for p in self.ranks]))
        key = left << 32 | right
        order = np.argsort(key)
        self.pair_key, self.pair_rank, self.pair_id = key[order], np.array([*self.ranks.values()], np.int32)[order], merged[order]
        self.never = np.int32(n)
        self.byte_id = np.array([ids[c] for c in self.letters] + [ids[c + self.end] for c in self.letters], np.int64)
        pairs = np.repeat(self.byte_id[:256], 512) << 32 | np.tile(self.byte_id, 256)
        self.byte_rank = self._find_pairs(pairs)[0].reshape(256, 512)

    def _find_pairs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs; a pair that isn't merged has the rank ``never``."""
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], self.never), self.pair_id[at]

    def merge_all(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, a row of bytes each: a row of ids each, and how many of the row count.

        In each step every word merges its pair of least rank, leftmost first.
        """
        n, size = words.shape
        code = words.astype(np.int64)
        code[:, -1] += 256
        ids = self.byte_id[code]
        rank = self.byte_rank[code[:, :-1], code[:, 1:]] if size > 1 else np.zeros((n, 0), np.int32)
        result, length = np.zeros((n, size), np.int64), np.full(n, size)
        rows = np.arange(n)  # those that may still merge; they have merged equally often, so all have one length
        while len(rows) and rank.shape[1]:
            best = rank.argmin(1)
            done = rank[np.arange(len(rows)), best] == self.never
            if done.any():
                result[rows[done], : ids.shape[1]], length[rows[done]] = ids[done], ids.shape[1]
                rows, ids, rank, best = rows[~done], ids[~done], rank[~done], best[~done]
            at = np.arange(len(rows))
            merged = self._find_pairs(ids[at, best] << 32 | ids[at, best + 1])[1]
            later = np.arange(ids.shape[1] - 1) > best[:, None]
            ids = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[at, best] = merged
            rank = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])  # the pair itself goes; those beside it have other ranks now
            for inside, side in ((best < rank.shape[1], 0), (best > 0, -1)):
                k = best[inside] + side
                rank[at[inside], k] = self._find_pairs(ids[at[inside], k] << 32 | ids[at[inside], k + 1])[0]
        result[rows, : ids.shape[1]], length[rows] = ids, ids.shape[1]
        return result, length

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if len(word) > LONG_WORD:
            parts = [self.letters[b] for b in word]
            parts[-1] += self.end
            return [self.vocab[p] for p in self._merge_long(parts)]
        ids, length = self.merge_all(np.frombuffer(word, np.uint8)[None, :])
        return ids[0, : length[0]].tolist()

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges with a heap of pairs and linked parts, in n log n steps."""
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, k) for k, pair in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            n = after[k]
            if not parts[k] or n < 0 or self.ranks.get((parts[k], parts[n])) != rank:
                continue  # one of the two has been merged meanwhile
            parts[k] += parts[n]
            parts[n] = ""
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p]


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to id lists, as a flat file.

    Layout, little-endian: counts of nodes, arcs, words and ids (4 x uint32);
    then as int32 arrays: whether a word ends at each node, target of each arc, words skipped by it, first id of each word
    (words + 1), the ids; and 256 x node + byte of each arc, ascending.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    nodes: list[list] = [[False, []]]  # [ends a word, [(byte, target), ...]]
    known: dict[tuple, int] = {}
    path = [0]  # nodes of the last word, not yet shared
    last = b""

    def share(down_to: int) -> None:
        while len(path) - 1 > down_to:
            node = path.pop()
            key = (nodes[node][0], tuple(nodes[node][1]))
            same = known.setdefault(key, node)
            if same != node:
                parent = nodes[path[-1]][1]
                parent[-1] = (parent[-1][0], same)

    for word, _ in words:
        common = len(os.path.commonprefix([word, last]))
        share(common)
        for b in word[common:]:
            nodes.append([False, []])
            nodes[path[-1]][1].append((b, len(nodes) - 1))
            path.append(len(nodes) - 1)
        nodes[path[-1]][0] = True
        last = word
    share(0)

    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for _, target in nodes[stack.pop()][1]:
            if target not in number:
                number[target] = len(order)
                order.append(target)
                stack.append(target)
    below: dict[int, int] = {}

    def count(node: int) -> int:
        if node not in below:
            below[node] = nodes[node][0] + sum(count(t) for _, t in nodes[node][1])
        return below[node]

    ends, targets, skips, keys = [], [], [], []
    for at, node in enumerate(order):
        final, arcs = nodes[node]
        passed = int(final)
        for b, target in arcs:
            keys.append(at << 8 | b)
            targets.append(number[target])
            skips.append(passed)
            passed += count(target)
        ends.append(int(final))
    id_at = np.concatenate(([0], np.cumsum([len(ids) for _, ids in words]))).astype("<i4") if words else np.zeros(1, "<i4")
    ids = np.array([i for _, x in words for i in x], "<i4")
    parts = [struct.pack("<4I", len(order), len(targets), len(words), len(ids)), *(np.array(x, "<i4").tobytes() for x in (ends, targets, skips, id_at, ids, keys))]
    return b"".join(parts)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            flat = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), "<i4")
        nodes, arcs, words, ids = flat[:4].tolist()
        self.ends, self.target, self.skip, self.id_at, self.ids, self.key = np.split(flat[4:], np.cumsum([nodes, arcs, arcs, words + 1, ids]))

    def find_all(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ranks of words in a buffer of bytes, -1 where the lexicon lacks them: one step of the automaton for all words at a time."""
        found = np.full(len(starts), -1)
        if not len(self.key):
            return found
        active = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD))
        node, rank, k = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64), 0
        while len(active):
            key = node << 8 | text[starts[active] + k]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            k += 1
            goes = self.key[arc] == key
            active, arc, rank = active[goes], arc[goes], rank[goes]
            node, rank = self.target[arc].astype(np.int64), rank + self.skip[arc]
            over = lengths[active] == k
            whole = over & (self.ends[node] > 0)
            found[active[whole]] = rank[whole]
            active, node, rank = active[~over], node[~over], rank[~over]
        return found

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if the lexicon lacks it."""
        rank = self.find_all(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0]
        return self.ids[self.id_at[rank] : self.id_at[rank + 1]].tolist() if rank >= 0 else None


def load_model(path: str) -> Model:
    """The model of a file; a task reads it once and lets it go at its end, as workers outlive tasks."""
    return Model(path)


def _pieces(text: str) -> list[str]:
    """A text in pieces of CHUNK_CHARS at most that end at blanks, where there are any."""
    found, start = [], 0
    while len(text) - start > CHUNK_CHARS:
        blank = next((m.start() for m in _CUT.finditer(text, start + CHUNK_CHARS)), len(text))
        found.append(text[start:blank])
        start = blank
    return [*found, text[start:]]


def _firsts(number: np.ndarray) -> np.ndarray:
    """Where each number comes first."""
    one = np.full(int(number.max(initial=-1)) + 1, -1)
    one[number[::-1]] = np.arange(len(number))[::-1]
    return one


def usual_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of usual texts, the number of each word in turn, and the place of each text's first word (texts + 1 values)."""
    low = [unicodedata.normalize("NFC", t).lower() for t in texts]
    joined = "\n".join([*low, ""])
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts, ends = cut_words(chars)
    number = pd.factorize(word_names(chars, starts, ends))[0]
    one, length = _firsts(number), ends - starts
    same = one[number]
    if (length != length[same]).any() or (chars[ragged(starts, length)] != chars[ragged(starts[same], length)]).any():  # different words with one hash
        number = pd.factorize(np.array([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())], object))[0]
        one = _firsts(number)
    words = [joined[a:b].encode() for a, b in zip(starts[one].tolist(), ends[one].tolist())]
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
    return words, number, np.searchsorted(starts, bounds)


def split_texts(model: Model, texts: list[str]) -> Iterator[tuple[list[tuple[int, int | None]], list[bytes], np.ndarray, np.ndarray]]:
    """Cuts texts into words, in chunks of bounded size.

    Gives for each chunk its pieces in order, (text, None) or (text, id of a
    special token); the different words, the number of each word in turn, and
    the place of each piece's first word (pieces + 1 values).
    """
    usual: list[tuple[int, str]] = []
    odd: list[tuple[int, int | None, str]] = []
    size = odd_size = 0

    def flush_usual():
        words, number, bounds = usual_words([t for _, t in usual])
        return [(k, None) for k, _ in usual], words, number, bounds

    def flush_odd():
        known: dict[bytes, int] = {}
        number, bounds = [], [0]
        for _, special, text in odd:
            if special is None:
                number += [known.setdefault(w, len(known)) for w in model.library_words(text)]
            bounds.append(len(number))
        return [(k, special) for k, special, _ in odd], [*known], np.array(number, np.int64), np.array(bounds)

    for k, whole in enumerate(texts):
        if _UNUSUAL.search(whole) is None and not (model.split_special and "<|" in whole):
            for text in _pieces(whole):
                usual.append((k, text))
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield flush_usual()
                    usual, size = [], 0
        else:
            for j, part in enumerate(model.parts(whole)):
                odd += [(k, model.special[part], "")] if j % 2 else [(k, None, text) for text in _pieces(part)]
            odd_size += len(whole)
            if odd_size >= CHUNK_CHARS:
                yield flush_odd()
                odd, odd_size = [], 0
    if usual:
        yield flush_usual()
    if odd:
        yield flush_odd()


class Codec:
    """Encodes and decodes."""

    def __init__(self, model: Model, lexicon: Lexicon | None):
        self.model, self.lexicon = model, lexicon
        self.names = np.array([model.token[i] for i in range(max(model.token) + 1)], object)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and the place of each word's first (words + 1 values)."""
        lengths = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        rank = self.lexicon.find_all(text, starts, lengths) if self.lexicon else np.full(len(words), -1)
        known = np.flatnonzero(rank >= 0)
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # words and their ids, one after another
        if len(known):
            first = self.lexicon.id_at[rank[known]].astype(np.int64)
            counts[known] = self.lexicon.id_at[rank[known] + 1] - first
            parts.append((known, self.lexicon.ids[ragged(first, counts[known])]))
        rest = np.flatnonzero(rank < 0)
        for size in np.unique(lengths[rest]).tolist():
            these = rest[lengths[rest] == size]
            if size > LONG_WORD:
                merged = [self.model.merge(words[w]) for w in these.tolist()]
                counts[these] = [len(m) for m in merged]
                parts.append((these, np.array([i for m in merged for i in m], np.int64)))
            else:
                ids, counts[these] = self.model.merge_all(text[starts[these][:, None] + np.arange(size)])
                parts.append((these, ids[np.arange(size) < counts[these][:, None]]))
        at = np.concatenate(([0], np.cumsum(counts)))
        ids = np.zeros(at[-1], np.uint32)
        for these, found in parts:
            ids[ragged(at[these], counts[these])] = found
        return ids, at

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found: list[list[bytes]] = [[] for _ in texts]
        for pieces, words, number, bounds in split_texts(self.model, texts):
            ids, at = self.ids_of(words)
            flat = ids[ragged(at[number], at[number + 1] - at[number])].astype("<u4", copy=False)
            ends = np.concatenate(([0], np.cumsum(at[number + 1] - at[number])))[bounds].tolist()
            for (k, special), a, b in zip(pieces, ends, ends[1:]):
                found[k].append(flat[a:b].tobytes() if special is None else struct.pack("<I", special))
        return [b"".join(x) for x in found]

    def decode(self, ids: bytes) -> str:
        """Token names with spaces between them, as the file names no decoder."""
        return " ".join(self.names[np.frombuffer(ids, "<u4")].tolist())


def count_pieces(docs: DataFrame, text_col: str, tokenizer: str) -> DataFrame:
    """Words of the corpus, of LONG_WORD bytes at most, and how often all its texts have them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(tokenizer)

        def rows(found: Counter) -> pa.RecordBatch:
            short = [(w, n) for w, n in found.items() if len(w) <= LONG_WORD]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.binary()).cast(pa.string()), pa.array([n for _, n in short], pa.int64())], names=["piece", "n"])

        found: Counter = Counter()
        for batch in slices(batches, 0):
            for _, words, number, _ in split_texts(model, [t or "" for t in batch.column(0).to_pylist()]):
                found.update(dict(zip(words, np.bincount(number, minlength=len(words)).tolist())))
                if len(found) > COUNTED_WORDS:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    return docs.select(text_col).mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str, tokenizer: str, words: int = LEXICON_WORDS) -> bytes:
    """The lexicon of the corpus's most frequent words, ``words`` at most; words that come up once are left out.

    A histogram of counts, in steps of a hundredth, gives the least count that
    fits, so that no more than the chosen words reach the driver.
    """
    step = F.floor(F.log("n") * 100)
    counts = stored(count_pieces(docs, text_col, tokenizer).where("n > 1").withColumn("step", step.cast("int")), "counts")
    least, fit = None, 0
    for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect():
        if fit + r.k > words:
            break
        least, fit = r.step, fit + r.k
    frequent = counts.where(F.col("step") >= least).select("piece").collect() if fit else []
    discard(counts)
    ids, at = Codec(load_model(tokenizer), None).ids_of([r.piece.encode() for r in frequent])
    return compile_lexicon({r.piece: ids[a:b].tolist() for r, a, b in zip(frequent, at.tolist(), at[1:].tolist())})


def encode_documents(docs: DataFrame, tokenizer: str, doc_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS, with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, for each row.

    ``with_ids`` adds the ids and the decoded text; ``keep`` names further
    columns to pass through, of which those are left out that are named like
    one of the results. A null text counts as empty: no ids, and the decoded
    text ''. Texts of any length are encoded whole, in pieces that end at
    blanks; no ties can arise. Repeated rows are encoded each; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    flat = build_lexicon(docs, text_col, tokenizer, words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory(prefix="millrace-") as folder:
        with open(os.path.join(folder, name), "wb") as f:
            f.write(flat)
        target = claimed(f"{shared_dir(spark)}/{name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(path(os.path.join(folder, name)), path(target))
    spark.sparkContext.addFile(target)  # every executor fetches it from the shared folder, later ones too

    made = {"n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ())}
    passed = [c for c in dict.fromkeys([doc_col, *(keep or [])]) if c not in made]
    rows = docs.select(*dict.fromkeys([*passed, text_col]))
    text_at = rows.columns.index(text_col)
    passed_at = [rows.columns.index(c) for c in passed]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(load_model(tokenizer), Lexicon(SparkFiles.get(name)))
        for batch in slices(batches, text_at):
            counts, id_sums, text_sums, all_ids, decoded = [], [], [], [], []
            for ids in codec.encode_all([t or "" for t in batch.column(text_at).to_pylist()]):
                text = codec.decode(ids)
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    decoded.append(text)
            columns = [*(batch.column(k) for k in passed_at), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            names = [*passed, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    if with_ids:
        fields += ["ids array<int>", "decoded string"]
    return rows.mapInArrow(encoded, ", ".join(fields))
