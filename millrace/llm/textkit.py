"""Vectorised tokenising of Arrow text columns with numpy.

A batch of texts is handled in chunks of bounded size. Every text of a chunk
is followed by a newline byte, so runs never cross texts. Words, lines and
shingles are named by 64-bit polynomial hashes that come from prefix sums over
the bytes, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk by itself.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C17, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(fold_ascii_case: bool) -> np.ndarray:
    """A 64-bit code for each byte, the same for A-Z and a-z if asked for."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold_ascii_case:
        codes[65:91] = codes[97:123]
    return codes


def byte_set(members: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: The separators of words [^\x20\x09-\x0D]+.
BLANKS = byte_set(b" \t\n\x0b\x0c\r")
#: Everything in ASCII but letters.
NOT_LETTERS = ~byte_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def _power_table(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(length, CHUNK_BYTES + 1)
    if "up" in _powers and len(_powers["up"]) >= size:
        return _powers["up"], _powers["down"]
    with np.errstate(over="ignore"):
        tables = []
        for factor in (_BASE, _INVERSE):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
    if size <= 8 * CHUNK_BYTES:
        _powers["up"], _powers["down"] = tables
    return tables[0], tables[1]


@dataclass
class Chunk:
    """Consecutive texts of one batch: rows ``first`` to ``first + n``."""

    first: int
    data: np.ndarray  # bytes of all texts, each followed by a newline
    offsets: np.ndarray  # n + 1 starts

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def runs(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of other bytes, and for each text the index of its first run (n + 1 values)."""
        inside = np.empty(len(self.data) + 1, bool)
        inside[0] = False
        np.take(~separators, self.data, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for lines, empty ones too."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hasher(self, codes: np.ndarray):
        """A function from (starts, ends) to 64-bit hashes of those spans."""
        up, down = _power_table(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(codes[self.data] * up[: len(self.data)], out=sums[1:])
        return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts])


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[Chunk]:
    """Chunks of a text column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total = np.concatenate(([0], np.cumsum(sizes)))
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(total, total[first] + CHUNK_BYTES, side="right")) - 1)
        part = pc.fill_null(texts.slice(first, last - first).cast(pa.large_string()), "")
        part = pc.binary_join_element_wise(part, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        yield Chunk(first, data, offsets - offsets[0])
        first = last


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each, in column ``text_at``, have so many bytes at most, or are a single one."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, first = np.concatenate(([0], np.cumsum(sizes))), 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(total, total[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def owner(first_runs: np.ndarray) -> np.ndarray:
    """The text of each run, from the index of each text's first run."""
    return np.repeat(np.arange(len(first_runs) - 1), np.diff(first_runs))


def sums_by_text(values: np.ndarray, first_runs: np.ndarray) -> np.ndarray:
    """Sums of values over the runs of each text."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values, dtype=np.int64 if values.dtype == bool else values.dtype)))
    return total[first_runs[1:]] - total[first_runs[:-1]]


#: Bytes of one text whose words are lists at once.
PIECE_BYTES = 1 << 20
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_PLAIN = bytes(32 if b in _SIGNS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_bytes(texts: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text of a column; a null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    data = memoryview(texts.buffers()[2] or b"")
    for start, end in zip(offsets, offsets[1:]):
        yield data[start:end]


def pieces(text: memoryview, separators: bytes) -> Iterator[bytes]:
    """A text cut before separators into pieces of about PIECE_BYTES; a longer run is never cut."""
    start = 0
    while start < len(text):
        end, at = start + PIECE_BYTES, len(text)
        while end < len(text):
            near = bytes(text[end : end + 4096]).translate(None, separators)  # as long as before if no separator is in it
            if len(near) < min(4096, len(text) - end):
                at = end + next(k for k, x in enumerate(bytes(text[end : end + 4096])) if x in separators)
                break
            end += 4096
        yield bytes(text[start:at])
        start = at


def blank_words(text: memoryview) -> Iterator[list[bytes]]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, piece by piece."""
    for piece in pieces(text, b" \t\n\x0b\x0c\r"):
        yield piece.translate(_LOWER).split()


def plain_words(text: memoryview) -> Iterator[list[bytes]]:
    """Runs of letters, digits and all beyond ASCII, with A-Z lower-cased, piece by piece."""
    for piece in pieces(text, _SIGNS):
        yield piece.translate(_PLAIN).split()
