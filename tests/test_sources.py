import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import cleaning
from millrace.plans import pipeline
from millrace.sources import catalog, files, json_array, sheets
from millrace.types import ROW_ID, IngestionError, step_table


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("odd", ["4,5,6,SEVEN", "4,5,6,", '"a\nb",5,6,7', '4,"5,5",6,"7"'])
def test_records_with_too_many_fields_are_refused(spark, tmp_path, odd):
    path = tmp_path / "a.csv"
    path.write_text(f"a,b,c\n1,2,3\n{odd}\n7,8\n")
    with pytest.raises(IngestionError, match="1 records have more fields than the 3 of the header") as e:
        files.ingest(spark, str(path))
    assert str(e.value).endswith(odd)


def test_short_records_and_delimiters_in_values_are_read(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('a,b,c\n1,2,3\n7,8\n"x,y","q""z",w\n5" p,"1,2",6"\n\n')
    got = files.ingest(spark, str(path)).dataframe
    assert [tuple(r)[:3] for r in got.collect()] == [("1", "2", "3"), ("7", "8", None), ("x,y", 'q"z', "w"), ('5" p', "1,2", '6"')]


def test_misfits_of_a_file_in_many_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "many.csv"
    path.write_text("a|b\n" + "".join(f"{k}|x{'|more' * (k % 97 == 5)}\n" for k in range(5000)))
    got = files.misfits(spark, str(path), 2, "|").collect()
    assert sorted(int(r.record.split("|")[0]) for r in got) == [k for k in range(5000) if k % 97 == 5] and {r.fields for r in got} == {3}
    with pytest.raises(IngestionError, match="52 records"):
        files.ingest(spark, str(path))


@pytest.mark.parametrize("format", ["csv", "json", "xlsx"])
def test_one_file_from_many_parts(spark, tmp_path, format):
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit('a"b,<&>\n\x01 é'), F.col("id").cast("string")))
    df = spark.range(500, numPartitions=8).select("id", text.alias("t"), (F.col("id") / 8).alias("v"), (F.col("id") % 2 == 0).alias("flag"), F.lit(None).cast("string").alias("none"))
    path = files.download(df, str(tmp_path), "sales.v2.csv", format, ["id"])
    assert path == f"{tmp_path}/sales.v2_cleaned.{format}" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == [f"sales.v2_cleaned.{format}"]
    back = files.ingest(spark, path).dataframe.orderBy(ROW_ID).collect()
    control = "" if format == "xlsx" else "\x01"  # a workbook can't hold it
    assert [(int(r.id), r.t, float(r.v)) for r in back] == [(k, f'a"b,<&>\n{control} é{k}' if k % 3 == 0 else None, k / 8) for k in range(500)]
    if format == "json":
        assert list(json.loads((tmp_path / "sales.v2_cleaned.json").read_text())[1]) == ["id", "t", "v", "flag", "none"]
    with pytest.raises(Exception):  # nothing is written over
        files.download(df, str(tmp_path), "sales.v2.csv", format, ["id"])


@pytest.mark.parametrize("format", ["csv", "json", "xlsx"])
def test_one_file_of_no_rows(spark, tmp_path, format):
    path = files.download(spark.range(0).toDF("a"), str(tmp_path), "none", format)
    if format == "json":
        assert json.loads(open(path).read()) == []
    else:
        got = files.ingest(spark, path)
        assert got.dataframe.count() == 0 and "a" in got.dataframe.columns and "no rows" in got.warnings[-1]


def made(rng, depth=0):
    """A JSON value that is hard to cut."""
    kind = rng.random()
    if kind < 0.4:
        return rng.choice(["a", "}{", '"', "\\", '\\"}', "é€", "]", "x" * 50, '{"a":1}', "\n", "[" * 5])
    if kind < 0.6 or depth > 2:
        return rng.choice([rng.randint(0, 99), None, True])
    return [made(rng, depth + 1) for _ in range(3)] if kind < 0.8 else {k: made(rng, depth + 1) for k in "pq}"}


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_in_many_ranges(spark, tmp_path, small_ranges, indent):
    rng = random.Random(5)
    records = [{"z": -1, "s": "x" * 9000, "inner": None}] + [{"z": k, "s": made(rng), "inner": {"list": [made(rng), {"}": "]"}]}} for k in range(400)] + [{"z": 400, "s": "}" * 9000, "inner": None}, {"z": 401, "s": "\\\"" * 3000, "inner": {}}]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=False))
    got = json_array.records(spark, str(path)).orderBy(ROW_ID).collect()
    assert [json.loads(r["value"]) for r in got] == records
    assert json_array.pieces(spark, str(path)).select("range").distinct().count() > 10
    df = files.ingest(spark, str(path)).dataframe
    assert [r.z for r in df.orderBy(ROW_ID).collect()] == list(range(-1, 402)) and df.columns[:3] == ["z", "s", "inner"]


def test_json_of_other_forms_and_encodings(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_bytes('[{"a":"é€"}]'.encode("cp1252"))
    got = files.ingest(spark, str(path))
    assert got.encoding == "cp1252" and got.dataframe.first().a == "é€"
    path.write_bytes(b"\xef\xbb\xbf[]")
    assert "no rows" in files.ingest(spark, str(path)).warnings[-1]
    for bad in ('[{"a":1},{"a":', '[{"a":1}', '[{"a":"x}]'):
        path.write_text(bad)
        with pytest.raises(IngestionError):
            files.ingest(spark, str(path))


def test_workbook_with_shared_strings_dates_and_gaps(spark, tmp_path):
    """A workbook as spreadsheets write it: cells by reference, styles of dates, a second sheet."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    path = tmp_path / "w.xlsx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="One" sheetId="1" r:id="r2"/><sheet name="Two" sheetId="2" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/b.xml"/><Relationship Id="r2" Target="worksheets/a.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Zo</t></r><r><t>ë</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="str"><v>day</v></c><c r="D1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="D2" t="b"><v>1</v></c></row><row r="4"><c r="B4" s="3"><v>1.5</v></c><c r="D4" t="e"><v>#N/A</v></c></row>'
        book.writestr("xl/worksheets/a.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
        book.writestr("xl/worksheets/b.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    got = files.ingest(spark, str(path))
    assert got.sheet == "One" and "Two" in got.warnings[0]
    df = got.dataframe
    assert df.columns == ["name", "day", "Unnamed: 2", "name.1", ROW_ID]
    assert [tuple(r)[:4] for r in df.orderBy(ROW_ID).collect()] == [("Zoë", "2024-01-01 12:00:00", None, "True"), (None,) * 4, (None, "1.5", None, None)]
    path.write_bytes(b"no workbook")
    with pytest.raises(IngestionError):
        files.ingest(spark, str(path))
    assert sheets._column("AB12") == 27


def test_registry_outlives_the_session(spark, tmp_path):
    root = str(tmp_path / "kept")
    raw = catalog.register(spark.createDataFrame([(k % 3, f"n{k % 3}") for k in range(9)], "a int, b string"), "raw", root=root)
    out, trail = pipeline.run_pipeline(catalog.get(spark, raw, root), order_by=["a"])
    view = catalog.register(out, "clean", parent=raw, warnings=["one"], trail=step_table(spark, trail), root=root)
    other = spark.newSession()
    assert catalog.get(other, view, root).count() == 9 and catalog.summary(other, view, root)["parent"] == raw
    assert [r.step for r in catalog.audit_trail(other, view, root).collect()] == [s.step for s in trail]
    assert {r.name for r in catalog.datasets(other, root).collect()} == {"raw", "clean"} and catalog.ancestors(other, view, root) == ["raw"]
    for bad in (lambda: catalog.get(other, "dataset_none", root), lambda: catalog.audit_trail(other, raw, root), lambda: catalog.register(out, "x", parent="dataset_none", root=root)):
        with pytest.raises(KeyError):
            bad()


def test_steps_that_are_written_are_counted_while_they_are(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else "x") for k in range(20)], "a int, b string")
    out, step = pipeline.run_step(df, "impute_missing", lambda d: cleaning.impute_missing(d))
    assert (step.rows_before, step.rows_after, step.nulls_before, step.nulls_after) == (20, 20, 5, 0) and out.count() == 20
