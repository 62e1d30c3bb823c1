"""One file from many tasks: parts are written by tasks, in order, and joined where they lie."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiling import family, quoted

#: Rows of a spreadsheet, without its header.
SHEET_ROWS = 1_048_575
_BUFFER = 1 << 16

# The parts of a workbook with one sheet.
_SHEET = "xl/worksheets/sheet1.xml"
_WORKBOOK = {
    "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def joined(lines: DataFrame, path: str, copy: Callable) -> None:
    """Writes the rows of a text column as parts beside ``path``, hands (JVM, the new file's stream, streams of the parts in order) to ``copy``, and removes the parts.

    What passes through the driver is a buffer of 64 KB at a time.
    """
    spark = lines.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.write.text(parts)
    jvm = spark.sparkContext._jvm
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        found = sorted((s.getPath() for s in system.listStatus(folder) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        out = system.create(target, False)
        try:
            copy(jvm, out, (system.open(p) for p in found))
        finally:
            out.close()
    finally:
        system.delete(folder, True)


def write_lines(lines: DataFrame, path: str, before: str = "", after: str = "", skip: int = 0) -> None:
    """One text file of the rows of ``lines`` between two texts; ``skip`` leaves out the first bytes of all rows together."""
    def copy(jvm, out, parts) -> None:
        out.write(before.encode())
        for k, part in enumerate(parts):
            if not k:
                part.seek(skip)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, _BUFFER, False)
            part.close()
        out.write(after.encode())

    joined(lines, path, copy)


def write_csv(rows: DataFrame, path: str) -> None:
    """A header, and a line for each row."""
    spark, options = rows.sparkSession, {"escape": '"'}
    header = spark.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(f"c{k}") for k, c in enumerate(rows.columns))), options)).first()[0]
    lines = F.to_csv(F.struct(*(quoted(c).cast("string").alias(f"c{k}") for k, c in enumerate(rows.columns))), options)
    write_lines(rows.select(lines.alias("value")), path, before=header + "\n")


def write_json(rows: DataFrame, path: str) -> None:
    """One array with an object for each row, nulls included."""
    record = F.to_json(F.struct(*(quoted(c) for c in rows.columns)), {"ignoreNullFields": "false"})
    write_lines(rows.select(F.concat(F.lit(","), record).alias("value")), path, before="[", after="]", skip=1)


def _cell(name: str, dtype: str) -> Column:
    c = quoted(name)
    if family(dtype) == "numeric":
        cell = F.concat(F.lit("<c><v>"), F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c).cast("string"), F.lit("</v></c>"))
    elif family(dtype) == "boolean":
        cell = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    else:
        text = F.to_json(c) if family(dtype) == "nested" and dtype != "binary" else c.cast("string")
        for sign, name_ in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(sign), F.lit(name_))
        text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        cell = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
    return F.coalesce(cell, F.lit("<c/>"))


def write_xlsx(rows: DataFrame, path: str) -> None:
    """A workbook with one sheet: tasks write the sheet's rows, the file system's stream packs them."""
    if rows.count() > SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} rows: write csv or parquet")
    lines = F.concat(F.lit("<row>"), *(_cell(c, t) for c, t in rows.dtypes), F.lit("</row>"))
    header = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in rows.columns)

    def copy(jvm, out, parts) -> None:
        packed = jvm.java.util.zip.ZipOutputStream(out)
        for name, text in _WORKBOOK.items():
            packed.putNextEntry(jvm.java.util.zip.ZipEntry(name))
            packed.write(bytearray(text.encode()))
        packed.putNextEntry(jvm.java.util.zip.ZipEntry(_SHEET))
        packed.write(bytearray(f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>{header}</row>'.encode()))
        for part in parts:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, packed, _BUFFER, False)
            part.close()
        packed.write(bytearray(b"</sheetData></worksheet>"))
        packed.finish()

    joined(rows.select(lines.alias("value")), path, copy)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
