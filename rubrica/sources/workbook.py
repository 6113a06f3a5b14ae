"""Excel workbooks (xlsx) without other libraries: a data source that reads ranges of rows in tasks, and a writer whose rows executors write.

    spark.dataSource.register(Workbook)
    spark.read.format("workbook").load("in.xlsx")

The first sheet is read, its first row holds the names. A column is of whole numbers, numbers or truth values where all its cells are, else of texts; moments are texts
(year-month-day hour:minute:second). Cells that read as missing are null, as are cells that a row lacks. A repeated name gets .1, .2 behind it, an empty one is "Unnamed: n".
The path may have any scheme that Arrow's file systems know; sheets are inflated as a stream, and neither driver nor task holds more rows than a batch.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from rubrica.plans.staging import delete, hadoop_path

# Name spaces of the format, numbers of its formats for moments, cells that read as missing.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MOMENTS = {*range(14, 23), *range(45, 48)}
NO_VALUE = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
ROWS, BATCH = 50_000, 2_000


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class Book:
    """The first sheet of a file, row by row."""

    def __init__(self, path: str) -> None:
        store, name = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]+:", path) else (fs.LocalFileSystem(), path)
        self.zip = zipfile.ZipFile(store.open_input_file(name))
        links = {e.get("Id"): e.get("Target") for e in self.tree("xl/_rels/workbook.xml.rels")}
        book = self.tree("xl/workbook.xml")
        sheet = next(book.iter(f"{MAIN}sheet"))
        target = links[sheet.get(f"{LINK}id")]
        self.sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        base = next(book.iter(f"{MAIN}workbookPr"), None)
        self.start = datetime(1904, 1, 1) if base is not None and base.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.moments = self.moment_styles()
        self.strings = self.shared()

    def tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return ["".join(t.text or "" for part in item.iter() if part.tag in (f"{MAIN}r", f"{MAIN}si") for t in part.findall(f"{MAIN}t")) for item in self.tree("xl/sharedStrings.xml")]

    def moment_styles(self) -> set[int]:
        """Places of the cell styles that show moments."""
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        styles = self.tree("xl/styles.xml")
        plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", plain(f.get("formatCode")), re.I)}
        cells = next(styles.iter(f"{MAIN}cellXfs"), [])
        return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in own | MOMENTS}

    def cell(self, c: ElementTree.Element):
        """A text, a number, a truth value, or null."""
        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
        elif v is None or v.text is None:
            return None
        elif kind == "s":
            text = self.strings[int(v.text)]
        elif kind == "b":
            return v.text.strip() == "1"
        elif kind == "n":
            number = float(v.text)
            if int(c.get("s", 0)) in self.moments:
                return str((self.start + timedelta(days=number) + timedelta(microseconds=500_000)).replace(microsecond=0))
            return int(number) if number.is_integer() and not re.search("[.eE]", v.text) else number
        else:
            text = v.text
        return None if text in NO_VALUE else text

    def rows(self, first: int = 0, last: int | None = None) -> Iterator[list]:
        """The rows of some places, in order; rows that the file leaves out are empty lists."""
        at = -1
        with self.zip.open(self.sheet) as source:
            for _, element in ElementTree.iterparse(source):
                if element.tag != f"{MAIN}row":
                    continue
                number = int(element.get("r", at + 2)) - 1
                for skipped in range(at + 1, number):
                    if first <= skipped and (last is None or skipped < last):
                        yield []
                at = number
                if last is not None and number >= last:
                    return
                if number >= first:
                    out: list = []
                    for c in element.iterfind(f"{MAIN}c"):
                        place = column_number(c.get("r")) if c.get("r") else len(out)
                        out += [None] * (place + 1 - len(out))
                        out[place] = self.cell(c)
                    yield out
                element.clear()


def names_of(header: list, width: int) -> list[str]:
    out: list[str] = []
    for i in range(width):
        name = str(header[i]) if i < len(header) and header[i] is not None else f"Unnamed: {i}"
        n, base = 0, name
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def shape(path: str) -> tuple[T.StructType, int]:
    """The schema and the number of rows below the header, in one pass that keeps no row."""
    rows = Book(path).rows()
    header = next(rows, [])
    kinds: list[set] = [set() for _ in header]
    n = filled = 0
    for row in rows:
        n += 1
        if any(v is not None for v in row):
            filled = n
        kinds += [set() for _ in row[len(kinds) :]]
        for i, v in enumerate(row):
            if v is not None:
                kinds[i].add(type(v))
    pick = lambda k: T.LongType() if k == {int} else T.DoubleType() if k and k <= {int, float} else T.BooleanType() if k == {bool} else T.StringType()
    return T.StructType([T.StructField(name, pick(k)) for name, k in zip(names_of(header, len(kinds)), kinds, strict=True)]), filled


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class SheetReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, step: int) -> None:
        self.path, self.schema, self.step, self.tests = path, schema, step, []

    def partitions(self) -> list[Rows]:
        n = shape(self.path)[1]
        return [Rows(i + 1, min(n, i + self.step) + 1) for i in range(0, n, self.step)] or [Rows(1, 1)]

    def keeps(self, row: list) -> bool:
        for i, kind, value in self.tests:
            v = row[i]
            if not {"EqualTo": v is not None and v == value, "In": v is not None and v in (value or ()), "IsNull": v is None, "IsNotNull": v is not None}[kind]:
                return False
        return True

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fit = {T.StringType: lambda v: v if isinstance(v, str) else str(v), T.DoubleType: float, T.LongType: int, T.BooleanType: bool}
        casts = [fit[type(f.dataType)] for f in self.schema]
        kinds = {T.StringType: pa.string(), T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}
        schema = pa.schema([(f.name, kinds[type(f.dataType)]) for f in self.schema])
        held: list[list] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

        for row in Book(self.path).rows(partition.first, partition.last):
            row = [None if i >= len(row) or row[i] is None else cast(row[i]) for i, cast in enumerate(casts)]
            if self.keeps(row):
                held.append(row)
            if len(held) == BATCH:
                yield batch()
                held.clear()
        if held:
            yield batch()


class FilteringReader(SheetReader):
    """A reader of its own, for Spark refuses one that takes filters while its setting does not allow it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons with a column are made where rows are read; the others are left to Spark."""
        at = {f.name: i for i, f in enumerate(self.schema)}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in at and isinstance(f, EqualTo | In | IsNull | IsNotNull):
                self.tests.append((at[column], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f


class Workbook(DataSource):
    """spark.read.format("workbook"); options rowsPerPartition, and filters: true where spark.sql.python.filterPushdown.enabled is."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return shape(self.options["path"])[0]

    def reader(self, schema: T.StructType) -> SheetReader:
        kind = FilteringReader if self.options.get("filters", "false").lower() == "true" else SheetReader
        return kind(self.options["path"], schema, int(self.options.get("rowsPerPartition", ROWS)))


# --- writing ---

PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
MOST_ROWS = 1_048_575


def row_xml(values: list) -> str:
    """A row of cells; its place is left out, for rows follow each other."""
    out = []
    for v in values:
        if v is None:
            out.append("<c/>")
        elif isinstance(v, bool):
            out.append(f'<c t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, int | float) and v == v and abs(v) != float("inf"):
            out.append(f"<c><v>{v!r}</v></c>")
        else:
            out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(BAD.sub("", str(v))).replace(chr(13), "&#13;")}</t></is></c>')
    return f"<row>{''.join(out)}</row>"


def write_workbook(df: DataFrame, path: str, title: str = "Sheet1") -> None:
    """One workbook in the order of df's rows; executors write the rows, whose bytes are then packed. More rows than the format holds are a ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([row_xml(list(r)) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)], pa.string())], ["value"])

    spark, folder = df.sparkSession, f"{path}-parts"
    lines = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, "value string")
    lines.write.mode("overwrite").option("lineSep", "\n").text(folder)
    if spark.read.text(folder, wholetext=False).where("value like '%</row>'").count() > MOST_ROWS:
        delete(spark, folder)
        raise ValueError(f"a workbook holds {MOST_ROWS} rows at most")
    (target, store), (parts, _) = hadoop_path(spark, path), hadoop_path(spark, folder)
    if store.getClass().getSimpleName().endswith("LocalFileSystem"):
        store = store.getRawFileSystem()
    zipped = spark._jvm.java.util.zip
    out = zipped.ZipOutputStream(store.create(target, True))
    book = f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-1]}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>'
    try:
        for name, text in [*PARTS.items(), ("xl/workbook.xml", book)]:
            out.putNextEntry(zipped.ZipEntry(name))
            out.write(bytearray(f'<?xml version="1.0" encoding="UTF-8"?>{text}'.encode()))
        out.putNextEntry(zipped.ZipEntry("xl/worksheets/sheet1.xml"))
        out.write(bytearray(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{row_xml(df.columns)}'.encode()))
        for name in sorted(s.getPath().getName() for s in store.listStatus(parts) if s.getPath().getName().startswith("part-")):
            part = store.open(spark._jvm.org.apache.hadoop.fs.Path(parts, name))
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(part, out)
            part.close()
        out.write(bytearray(b"</sheetData></worksheet>"))
    finally:
        out.close()
    delete(spark, folder)
