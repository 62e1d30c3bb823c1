"""A JSON array of any size, read by many tasks.

The file is cut into pieces after each ``}``, which the text reader does in
byte ranges. Whether a range begins inside a string, and how deep, is not known
to the task that reads it, so a first pass sums it up for both cases: does it
end in the other state, by how much does the depth change, how low does it
get. A prefix over these sums, one row for each range, tells where each range
really begins, and a second pass cuts records where the depth returns to 1.
What a border cuts is put together again by the range where it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import ROW_ID, IngestionError

#: What ends pieces; a byte that is no part of any other character.
CUT = "}"
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_MARKS = re.compile(rb'["{}\[\]]')


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``range`` (where a range of bytes begins) and ``piece``, in the order of the file within a range."""
    return spark.read.option("lineSep", CUT).text(path).select(F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("piece"))


def _depths(piece: bytes, inside: bool) -> Iterator[tuple[int, int, bool]]:
    """Places after brackets outside of strings, each with its step of depth; last the end of the piece, with whether it is inside a string."""
    for mark in _MARKS.finditer(piece):
        sign = piece[mark.start()]
        if sign == 0x22:
            inside = not inside
        elif not inside:
            yield mark.end(), 1 if sign in b"{[" else -1, inside
    yield len(piece), 0, inside


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and each state at its begin: whether it ends in a string, by how much the depth changes, and its least value after a closing bracket."""
    sums: dict[int, dict[bool, list]] = {}
    for batch in batches:
        for start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            clear = _ESCAPED.sub(b"", piece + b"}")
            own = sums.setdefault(start, {s: [s, 0, 1 << 30] for s in (False, True)})
            for state in own.values():
                for _, step, inside in _depths(clear, state[0]):
                    state[1] += step
                    if step < 0:
                        state[2] = min(state[2], state[1])
                state[0] = inside
    rows = [(start, entered, *state) for start, own in sums.items() for entered, state in own.items()]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["range", "entered", "inside", "change", "least"])


def _record_batches(begins: dict[int, tuple[bool, int, int]]):
    """Records of each range, by the ranges where they begin and go on: ``owner``, ``range``, ``k``, ``text`` and whether the record is whole."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}  # inside, depth, owner, parts of the open record, number of the next one

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["owner", "range", "k", "raw", "whole"])

        for batch in batches:
            rows = []
            for start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if start not in state:
                    inside, depth, owner = begins[start]
                    state[start] = [inside, depth, owner, [], 0]
                inside, depth, owner, parts, k = now = state[start]
                piece += b"}"
                masked = _ESCAPED.sub(b"  ", piece)
                begin = 0
                for end, step, inside in _depths(masked, inside):
                    before, depth = depth, depth + step
                    if before == 1 and step > 0:
                        begin, owner, parts = end - 1, start, []
                    elif depth == 1 and step < 0:
                        rows.append((owner, start, k, b"".join([*parts, piece[begin:end]]), owner == start))
                        parts, k = [], k + 1
                if depth > 1:
                    parts.append(piece[begin:])
                now[:] = [inside, depth, owner, parts, k]
            yield made(rows)
        yield made([(owner, start, k, b"".join(parts), False) for start, (_, depth, owner, parts, k) in state.items() if depth > 1])

    return batches_of


def records(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """``value``, the text of each object of an array, and ROW_ID, its position."""
    cut = pieces(spark, path)
    sums: dict[int, dict[bool, tuple]] = {}
    for r in cut.mapInArrow(_sum_batches, "range long, entered boolean, inside boolean, change long, least long").collect():  # two rows for each range
        sums.setdefault(r.range, {})[r.entered] = (r.inside, r.change, r.least)
    begins: dict[int, tuple[bool, int, int]] = {}
    inside, depth, owner = False, 0, 0
    for start in sorted(sums):
        begins[start] = inside, depth, owner
        ends_inside, change, least = sums[start][inside]
        if depth <= 1 or depth + least <= 1:
            owner = start  # an open record at the end begins here
        inside, depth = ends_inside, depth + change
    if inside or depth != -1:  # one less than 0, as a cut is put after the last piece too
        raise IngestionError(f"{path} ends inside of a value")
    found = cut.mapInArrow(_record_batches(begins), "owner long, range long, k long, raw binary, whole boolean")
    whole = found.where("whole").select(F.col("owner").alias("at"), "k", "raw")
    parts = found.where("not whole").groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("range", "k", "raw"))).alias("p"))  # the parts of one record
    again = parts.select(F.col("owner").alias("at"), F.lit(1 << 32).alias("k"), F.aggregate(F.col("p.raw"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("raw"))
    both = whole.union(again)
    number = F.create_map(*(F.lit(x) for k, start in enumerate(sorted(begins)) for x in (start, k)))
    place = F.shiftleft(F.element_at(number, F.col("at")).cast("long"), 33) + F.col("k")
    return both.select(F.decode("raw", charset).alias("value"), place.alias(ROW_ID))
