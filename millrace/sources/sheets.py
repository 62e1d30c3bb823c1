"""Spreadsheets, read by a task: a sheet is one packed stream of a million rows at most."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from ..types import ROW_ID, IngestionError

# Namespaces, and the number formats of dates that need no definition.
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_EPOCH = datetime(1899, 12, 30)
ROWS_AT_ONCE = 5_000


def unique_names(names: list[str]) -> tuple[list[str], list[str]]:
    """Names with .1, .2 after repeated ones, and those that were repeated."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}.{seen[n]}" if seen[n] else n)
    return out, [n for n, k in seen.items() if k]


def sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets, and the parts of the file that hold them."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")
    return [(s.get("name"), f"xl/{rels[s.get(_REL)]}".replace("xl//xl/", "xl/")) for s in sheets]


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, node in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
        if node.tag == f"{_NS}si":
            out.append("".join(t.text or "" for t in node.iter(f"{_NS}t")))
            node.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Styles of cells that hold dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
    cells = root.find(f"{_NS}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}


def _column(ref: str) -> int:
    place = 0
    for letter in re.match(r"[A-Z]+", ref)[0]:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind, raw = cell.get("t"), cell.findtext(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind is None and int(cell.get("s", 0)) in dates:
        return str(_EPOCH + timedelta(seconds=round(float(raw) * 86400)))
    return raw


def rows_of(content: bytes, place: int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet in order, those that the file leaves out as empty ones."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared, dates, at = _shared(book), _date_styles(book), 0
    for _, row in ElementTree.iterparse(book.open(sheet_names(book)[place][1])):
        if row.tag != f"{_NS}row":
            continue
        for _ in range(at, number := int(row.get("r", at + 1)) - 1):
            yield []
        cells: list[str | None] = []
        for cell in row.iter(f"{_NS}c"):
            cells += [None] * ((_column(cell.get("r")) if cell.get("r") else len(cells)) - len(cells))
            cells.append(_value(cell, shared, dates))
        yield cells
        row.clear()
        at = number + 1


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the first sheet, numbered; before them, as row -1, the names of all sheets."""
    for batch in batches:
        for content in batch.column(0):
            raw = content.as_py()
            at, rows = [-1], [[n for n, _ in sheet_names(zipfile.ZipFile(io.BytesIO(raw)))]]
            for k, cells in enumerate(rows_of(raw)):
                at.append(k)
                rows.append(cells)
                if len(rows) == ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["at", "cells"])
                    at, rows = [], []
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["at", "cells"])


def read_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The first sheet with its first row as header, all values as text, its position as ROW_ID, and the names of all sheets."""
    content = spark.read.format("binaryFile").load(path).select("content")
    try:
        table = stored(content.mapInArrow(_row_batches, "at long, cells array<string>"), "sheet")
    except Exception as e:
        raise IngestionError(f"{path} is no workbook of the xlsx form") from e
    heads = {r.at: r.cells for r in table.where("at <= 0").collect()}
    names = [n if n is not None else f"Unnamed: {k}" for k, n in enumerate(heads.get(0, []))]
    rows = table.where("at > 0")
    return rows.select(*(F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(len(names))), F.col("at").alias(ROW_ID)).toDF(*unique_names(names)[0], ROW_ID), heads[-1]
