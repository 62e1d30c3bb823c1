"""Reading and writing files."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import blank_to_null, parse_datetime
from ..operators.profiling import family, quoted, visible
from ..types import ROW_ID, IngestionError, UnsupportedFileType
from . import catalog, json_array, sheets, single
from .sheets import unique_names

# The tokens that stand for a missing value, and delimiters in the order of trial.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DELIMITERS = ",;\t|"
HEAD_BYTES = 1 << 20
_DIFFERENT = bytes(b for b in range(0x80, 0xA0) if b not in b"\x81\x8d\x8f\x90\x9d")
CP1252 = (_DIFFERENT.decode("latin1"), _DIFFERENT.decode("cp1252"))


@dataclass
class IngestResult:
    dataframe: DataFrame
    source_format: str
    encoding: str | None = None
    delimiter: str | None = None
    sheet: str | None = None
    warnings: list[str] = field(default_factory=list)


def head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, through the file system that Spark uses."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        raise IngestionError(f"{path} does not exist")
    stream = system.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, system.getFileStatus(target).getLen())))
    finally:
        stream.close()


def file_traits(spark: SparkSession, path: str, raw: bytes, line_end: str | None = None, delimiter: str = ",", width: int = 1 << 30) -> tuple[str, bool, bool]:
    """The encoding of a whole file that begins with ``raw``, found over all its lines, as no line break lies inside a character; whether a quoted value may hold a line break; and whether a line may have more than ``width`` fields."""
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    line = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    sign = "\\t" if delimiter == "\t" else "\\" + delimiter if delimiter in "|" else delimiter
    unquoted = F.regexp_replace(line, f'(^|{sign})"(?:[^"]|"")*"(?={sign}|$)', "$1")
    fields = lambda x: F.length(x) - F.length(F.translate(x, delimiter, ""))
    found = reader.text(path).agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_and(~F.regexp_like(line, F.lit("[\\x81\\x8D\\x8F\\x90\\x9D]"))), F.lit(True)).alias("cp1252"),
        F.coalesce(F.bool_or(F.length(F.translate(line, '"', "")) % 2 != F.length(line) % 2), F.lit(False)).alias("open"),
        F.coalesce(F.bool_or(F.when(fields(line) >= width, fields(unquoted) >= width)), F.lit(False)).alias("wide"),
    ).first()
    if found.utf8:
        return "utf-8-sig" if raw.startswith(codecs.BOM_UTF8) else "utf-8", found.open, found.wide
    return "cp1252" if found.cp1252 else "latin1", found.open, found.wide


def _charset(encoding: str) -> str:
    return "UTF-8" if encoding.startswith("utf-8") else "ISO-8859-1"  # Spark lacks cp1252; see CP1252


def _csv_reader(spark: SparkSession, delimiter: str, encoding: str, breaks: bool):
    return spark.read.option("header", True).option("sep", delimiter).option("encoding", _charset(encoding)).option("multiLine", breaks).option("escape", '"').option("inferSchema", False)  # without breaks in values, a file of any size is split


def misfits(spark: SparkSession, path: str, width: int, delimiter: str = ",", encoding: str = "utf-8", breaks: bool = False) -> DataFrame:
    """Records of a CSV file with more fields than ``width``: ``at`` (ascending in the file), ``record`` and ``fields``.

    Spark's reader tells records of another width apart; those alone are cut
    again, in tasks, to count their fields.
    """
    names = [f"c{k}" for k in range(width)]
    schema = ", ".join(f"{c} string" for c in (*names, "record"))
    read = _csv_reader(spark, delimiter, encoding, breaks).schema(schema).option("columnNameOfCorruptRecord", "record").option("columnPruning", False).csv(path)
    odd = read.withColumn("at", F.monotonically_increasing_id()).where("record is not null").select("at", "record", *names)

    def counted(batches):
        for batch in batches:
            fields = [len(next(csv.reader(io.StringIO(r), delimiter=delimiter), [])) for r in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fields, pa.int32())], names=["at", "record", "fields"])
            yield out.filter(pa.compute.greater(out.column(2), width))

    return odd.mapInArrow(counted, "at long, record string, fields int")


def sniff_delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:8192], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def normalised(df: DataFrame, na_tokens: tuple[str, ...] = ()) -> DataFrame:
    """Blank text, and text that stands for a missing value, as null; NaN as null."""
    out = []
    for c, t in df.dtypes:
        x = quoted(c)
        if t == "string":
            x = blank_to_null(F.when(~x.isin(*na_tokens), x) if na_tokens else x)
        elif t in ("float", "double"):
            x = F.when(~F.isnan(x), x)
        out.append(x.alias(c))
    return df.select(*out)


def ingest(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = NA_TOKENS) -> IngestResult:
    """Reads .csv, .tsv, .json, .xlsx or .parquet; rows get their position as ROW_ID."""
    extension = re.sub(r"^.*\.", ".", path.lower().rstrip("/"))
    if extension == ".parquet":
        result = IngestResult(normalised(spark.read.parquet(path)), "parquet")
    elif extension not in (".csv", ".tsv", ".txt", ".json", ".xlsx", ".xls"):
        raise UnsupportedFileType(f"{extension} files can't be read")
    else:
        raw = head(spark, path)
        if not raw:
            raise IngestionError(f"{path} is empty")
        result = {".json": _json, ".xlsx": _excel, ".xls": _excel}.get(extension, _csv)(spark, path, raw, na_tokens)
    if ROW_ID not in result.dataframe.columns:
        result.dataframe = result.dataframe.withColumn(ROW_ID, F.monotonically_increasing_id())
    if not result.dataframe.limit(1).count():
        result.warnings.append("the file has no rows")
    return result


def ingest_all(spark: SparkSession, paths: list[str], na_tokens: tuple[str, ...] = NA_TOKENS) -> list[tuple[str, IngestResult]]:
    """Reads and registers files one after another, each by its own name; the first that can't be read raises, and those before it stay registered."""
    if not paths:
        raise IngestionError("no files were given")
    found = []
    for path in paths:
        result = ingest(spark, path, na_tokens)
        found.append((catalog.register(result.dataframe, path.rstrip("/").rsplit("/", 1)[-1], warnings=result.warnings), result))
    return found


def _csv(spark: SparkSession, path: str, raw: bytes, na_tokens: tuple[str, ...]) -> IngestResult:
    """A record with fewer fields than the header has nulls in their place; one with more raises, as no column could hold the rest."""
    guessed = raw.decode("utf-8", "replace").removeprefix("\ufeff")
    delimiter = sniff_delimiter(guessed)
    width = len(next(csv.reader(guessed.splitlines(), delimiter=delimiter), [""]))
    encoding, breaks, wide = file_traits(spark, path, raw, delimiter=delimiter, width=width)
    text = codecs.getincrementaldecoder(encoding)().decode(raw)
    if breaks or wide:
        odd = misfits(spark, path, width, delimiter, encoding, breaks).agg(F.count(F.lit(1)).alias("n"), F.min_by("record", "at").alias("first")).first()
        if odd.n:
            raise IngestionError(f"{odd.n} records have more fields than the {width} of the header, the first of them: {odd.first}")
    df = _csv_reader(spark, delimiter, encoding, breaks).csv(path)
    if encoding == "cp1252":  # it names other characters by some bytes that latin1 has for controls
        df = df.select(*(F.translate(quoted(c), *CP1252).alias(c) for c in df.columns))
    names, repeated = unique_names(next(csv.reader(text.splitlines(), delimiter=delimiter), df.columns))
    if len(names) == len(df.columns):
        df = df.toDF(*names)
    warnings = [f"column {n} comes up more than once" for n in repeated]
    if len(df.columns) == 1 and delimiter != ",":
        warnings.append("only one column was found: is the delimiter right?")
    return IngestResult(normalised(df, na_tokens), "csv", encoding, delimiter, warnings=warnings)


def _json(spark: SparkSession, path: str, raw: bytes, na_tokens: tuple[str, ...]) -> IngestResult:
    """An array of objects is cut into records by many tasks; any other value is read whole."""
    encoding = file_traits(spark, path, raw, json_array.CUT)[0]
    df = None
    if raw.removeprefix(codecs.BOM_UTF8).lstrip()[:1] == b"[":
        records = json_array.records(spark, path, _charset(encoding))
        if encoding == "cp1252":
            records = records.withColumn("value", F.translate("value", *CP1252))
        lines = getattr(records.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(spark._jsparkSession.read().json(lines), spark).schema
        if schema.fields:
            first = [*json.loads((records.where(F.col(ROW_ID) == 0).first() or records.orderBy(ROW_ID).first())["value"])]  # columns come as records name them, not by the alphabet
            names = [c for c in first if c in schema.names] + [c for c in schema.names if c not in first]
            df = records.select(F.from_json("value", schema).alias("r"), ROW_ID).select(*(F.col("r")[c].alias(c) for c in names), ROW_ID)
        elif raw.removeprefix(codecs.BOM_UTF8).split() in ([b"[]"], [b"[", b"]"]):
            df = spark.range(0).select()
    if df is None:
        df = spark.read.option("multiLine", True).option("encoding", _charset(encoding)).json(path)
    if "_corrupt_record" in df.columns:
        raise IngestionError(f"{path} is no JSON table")
    if raw.lstrip()[:1] == b"{" and all(family(t) == "nested" for _, t in df.dtypes):
        df = _from_columns(df)
    named = [c for c, t in df.dtypes if t == "string" and re.search(r"(_at|_time)$|^timestamp|^(date|modified)$", c.lower())]
    if named:
        found = df.agg(*(F.count_if(blank_to_null(quoted(c)).isNotNull() & parse_datetime(quoted(c)).isNull()).alias(f"c{k}") for k, c in enumerate(named))).first()
        dates = [c for k, c in enumerate(named) if not found[k]]  # columns named like dates whose values all are dates
        df = df.select(*(parse_datetime(quoted(c)).alias(c) if c in dates else quoted(c) for c in df.columns))
    return IngestResult(normalised(df), "json", encoding)


def _from_columns(df: DataFrame) -> DataFrame:
    """One object of columns, each an array or an object by row key, as rows."""
    arrays = {}
    for field_ in df.schema.fields:
        if field_.dataType.typeName() == "struct":
            arrays[field_.name] = F.array(*(quoted(field_.name)[k.name] for k in field_.dataType.fields))
        else:
            arrays[field_.name] = quoted(field_.name)
    zipped = df.select(F.explode(F.arrays_zip(*(a.alias(c) for c, a in arrays.items()))).alias("r"))
    return zipped.select("r.*").toDF(*arrays)


def _excel(spark: SparkSession, path: str, raw: bytes, na_tokens: tuple[str, ...]) -> IngestResult:
    df, (name, *others) = sheets.read_sheet(spark, path)
    return IngestResult(normalised(df, na_tokens), "excel", sheet=name, warnings=[f"other sheets were not read: {', '.join(others)}"] if others else [])


def preview(df: DataFrame, limit: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """The first rows."""
    order = order_by or ([ROW_ID] if ROW_ID in df.columns else [])
    return (df.orderBy(*order) if order else df).limit(limit).select(*(quoted(c) for c in visible(df)))


def preview_counts(df: DataFrame, limit: int = 50) -> dict[str, int]:
    """Rows of the table, and rows that ``preview`` returns."""
    total = df.count()
    return {"total_rows": total, "returned_rows": min(limit, total)}


def cleaned_name(name: str, format: str = "csv") -> str:
    """The name under which a cleaned dataset is written."""
    return f"{name.rsplit('.', 1)[0] or 'dataset'}_cleaned.{format}"


SINGLE = {"csv": single.write_csv, "json": single.write_json, "xlsx": single.write_xlsx}


def ordered(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """The visible columns, in the order of the given ones or of the positions from ingestion."""
    order = order_by or ([ROW_ID] if ROW_ID in df.columns else [])
    return (df.orderBy(*order) if order else df).select(*(quoted(c) for c in visible(df)))


def write(df: DataFrame, path: str, format: str = "csv", order_by: list[str] | None = None) -> None:
    """One csv, json (an array) or xlsx file, of parts that tasks have written; or a folder of jsonl or parquet files."""
    rows = ordered(df, order_by)
    if format in SINGLE:
        SINGLE[format](rows, path)
    elif format == "jsonl":
        rows.write.json(path)
    elif format == "parquet":
        rows.write.parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def download(df: DataFrame, folder: str, name: str, format: str = "csv", order_by: list[str] | None = None) -> str:
    """Writes a cleaned dataset as one file under the name that is derived from its own; returns the path."""
    if format not in SINGLE:
        raise ValueError(f"unknown format {format!r}")
    path = f"{folder.rstrip('/')}/{cleaned_name(name, format)}"
    write(df, path, format, order_by)
    return path
