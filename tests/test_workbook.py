"""Workbooks in and out, by the data source and the writer."""

import csv
import zipfile

import pytest
from pyspark.sql import functions as F

from rubrica import __main__ as cli
from rubrica.sources import readers, sinks, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, rows, strings=(), styles="", start="", sheet="worksheets/s7.xml"):
    """A file as spreadsheet programs write it: shared strings, styles, a sheet of another name."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr {start}/><sheets><sheet name="First" sheetId="4" r:id="rId9"/><sheet name="Other" sheetId="5" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="rId1" Target="worksheets/no.xml"/><Relationship Id="rId9" Target="{sheet}"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        z.writestr("xl/worksheets/s7.xml", f"<worksheet {NS}><dimension ref='A1'/><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


STRINGS = ["<t>id</t>", "<t>name</t>", "<r><t>Ä</t></r><r><t xml:space='preserve'> b</t></r><rPh><t>no</t></rPh>", "<t>N/A</t>", "<t>day</t>", "<t/>"]
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'


def test_cells(spark, tmp_path):
    """Strings of all kinds, moments, truth values, gaps in rows and between them, repeated and missing names, trailing empty rows."""
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>1</v></c><c r="E1" t="s"><v>4</v></c></row>'
        '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>2.5</v></c><c r="E2" s="1"><v>45292.5</v></c><c r="F2" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="A4"><v>3</v></c><c r="B4" t="s"><v>3</v></c><c r="C4"><v>4</v></c><c r="D4" t="inlineStr"><is><t>in</t></is></c><c r="E4" s="2"><v>45293</v></c><c r="F4" t="b"><v>0</v></c></row>'
        '<row r="5"><c r="A5"><v>4</v></c><c r="B5" t="str"><v>f</v></c><c r="C5" s="3"><v>7</v></c><c r="D5" t="e"><v>#N/A</v></c><c r="E5" t="s"><v>5</v></c></row>'
        '<row r="6"/><row r="7"><c r="A7"/></row>'
    )
    path = book(tmp_path / "a.xlsx", rows, STRINGS, STYLES)
    df = readers.read_batch(spark, path)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("name.1", "double"), ("Unnamed: 3", "string"), ("day", "string"), ("Unnamed: 5", "boolean")]
    want = [(1, "Ä b", 2.5, None, "2024-01-01 12:00:00", True), (None,) * 6, (3, None, 4.0, "in", "2024-01-02 00:00:00", False), (4, "f", 7.0, None, None, None)]
    for step in (1, 2, 100):
        got = spark.read.format("workbook").option("rowsPerPartition", step).load(path)
        assert [tuple(r) for r in got.collect()] == want and got.rdd.getNumPartitions() == -(-4 // step)
    early = book(tmp_path / "mac.xlsx", '<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="1"><v>0</v></c></row>', (), STYLES, 'date1904="1"', "/xl/worksheets/s7.xml")
    assert readers.read_batch(spark, early).first()["d"] == "1904-01-01 00:00:00"
    with pytest.raises(ValueError, match="no rows"):
        readers.read_batch(spark, book(tmp_path / "none.xlsx", '<row r="1"><c r="A1" t="s"><v>0</v></c></row>', STRINGS))


def test_filters_are_made_where_rows_are_read(spark, tmp_path):
    rows = "<row><c t='inlineStr'><is><t>k</t></is></c><c t='inlineStr'><is><t>v</t></is></c></row>" + "".join(f"<row><c><v>{i}</v></c><c t='inlineStr'><is><t>{'ab'[i % 2] if i % 5 else ''}</t></is></c></row>" for i in range(60))
    path = book(tmp_path / "f.xlsx", rows)
    spark.dataSource.register(workbook.Workbook)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("workbook").option("rowsPerPartition", 25).option("filters", "true").load(path)
        for where, want in (("v = 'a'", 24), ("v is null", 12), ("k in (3, 7, 99)", 2), ("v = 'b' and k > 50", 4), ("v is not null and k % 2 = 0", 24)):
            assert df.where(where).count() == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = workbook.FilteringReader(path, df.schema, 10)
    left = list(reader.pushFilters([workbook.EqualTo(("v",), "a"), workbook.EqualTo(("no",), "a")]))
    assert len(left) == 1 and [workbook.Rows(i + 1, i + 11) for i in range(0, 60, 10)] == reader.partitions()
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 24


def test_what_is_written_is_read(spark, tmp_path):
    rows = [(i, None if i % 4 == 0 else f"ä<{i}>&\"' \r\n x", i / 4, i % 2 == 0, f"00{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string, x double, b boolean, code string").repartition(5)
    path = str(tmp_path / "w.xlsx")
    workbook.write_workbook(df.orderBy("id"), path, "R & D")
    got = readers.read_excel(spark, path)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == rows
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "xl/worksheets/sheet1.xml" in z.namelist()
    assert [p.name for p in tmp_path.iterdir()] == ["w.xlsx"]
    sinks.respond(df.select("id").withColumn("x", F.lit(float("inf"))).orderBy("id").limit(3), "xlsx", str(tmp_path / "r.xlsx"))
    assert readers.read_excel(spark, str(tmp_path / "r.xlsx")).columns == ["id", "x", "Overall Score", "Status", "Requirements Not Met"]
    with pytest.raises(ValueError):
        workbook.MOST_ROWS, kept = 2, workbook.MOST_ROWS
        try:
            workbook.write_workbook(df, path)
        finally:
            workbook.MOST_ROWS = kept


def test_column_names():
    assert [workbook.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook.column_number(f"{workbook.column_name(i)}12") == i for i in range(1000))


def test_command_line_scores_a_workbook(spark, tmp_path):
    head = ["id", "activity_name", "event_theme", "activity_duration", "student_participants", "faculty_participants", "event_driven", "report", "photo1"]
    spark.createDataFrame([(9, "Talk", "Theme", 3, 20, 2, 1, "none.pdf", "0")], ", ".join(f"{n} {'long' if i in (0, 3, 4, 5, 6) else 'string'}" for i, n in enumerate(head))).createOrReplaceTempView("batch")
    source, target = str(tmp_path / "in.xlsx"), str(tmp_path / "out.csv")
    workbook.write_workbook(spark.table("batch"), source)
    (tmp_path / "files").mkdir()
    assert cli.main([source, "--output-csv", target, "--files", str(tmp_path / "files"), "--log-level", "ERROR", "--non-interactive"]) == 0
    (row,) = csv.DictReader(open(target, encoding="utf-8-sig"))
    assert row["id"] == "9" and row["activity_name"] == "Talk" and row["Status"] == "Reopen"
