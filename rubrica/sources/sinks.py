"""Results out: CSV with a byte-order mark, JSON, Excel, and names of results."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.operators.score import coerced
from rubrica.plans.staging import hadoop_path
from rubrica.sources.workbook import write_workbook

SCORE = "Overall Score"


def output_name(source: str | None = None, now: datetime | None = None) -> str:
    """validation_results_<stem>_<time>.csv; characters that are no letters, digits, - or _ become _."""
    stem = re.sub(r"[^\w-]", "_", Path(source).stem) if source else None
    return "_".join(["validation_results", *([stem] if stem is not None else []), f"{now or datetime.now():%Y%m%d_%H%M%S}.csv"])


def whole_scores(df: DataFrame) -> DataFrame:
    """The score column as whole numbers; what is none counts 0. A missing result column gets its default."""
    defaults = {SCORE: F.lit(0), "Status": F.lit("Error"), "Requirements Not Met": F.lit("")}
    df = df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})
    return df.withColumn(SCORE, coerced(F.col(f"`{SCORE}`").cast("string")))


def write_parts(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder of CSV parts that follow each other in the given order; written by all executors."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).option("escape", '"').csv(path)


def plain(value):
    """A cell as Python's csv module shows it; a moment without its zone, in local time."""
    return value.astimezone().replace(tzinfo=None) if isinstance(value, datetime) and value.tzinfo else value


def csv_lines(df: DataFrame) -> DataFrame:
    """One text a row, as Python's csv module writes it; partitions and their order stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = io.StringIO(newline="")
                csv.writer(out, lineterminator="").writerow([plain(v) for v in row])
                lines.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, "value string")  # names may differ in case only


def write_joined(lines: DataFrame, path: str, head: str, between: str, tail: str = "", keep_last: bool = True) -> None:
    """One file of ordered lines, which executors write as parts: head, the lines with `between` behind each (unless the last one shall have none), tail.

    The parts are copied behind each other as bytes; no row reaches Python on the driver.
    """
    spark = lines.sparkSession
    name = path.replace("\\", "/").rpartition("/")
    parts = f"{name[0]}{name[1]}.{name[2]}-parts-{uuid.uuid4().hex}"
    lines.write.option("lineSep", between).text(parts)
    target, fs = hadoop_path(spark, path)
    folder, _ = hadoop_path(spark, parts)
    if fs.getClass().getSimpleName().endswith("LocalFileSystem"):  # without checksum files beside the result
        fs = fs.getRawFileSystem()
    copy = spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    sources = sorted(((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s[0])
    out = fs.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for i, (_, source, length) in enumerate(sources):
            n = length - len(between.encode()) * (not keep_last and i == len(sources) - 1)
            part = fs.open(source)
            copy(part, out, 0, n)
            part.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(folder, True)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """One UTF-8 CSV with a byte-order mark, as spreadsheets want it, in the order of df's rows (sort it before)."""
    head = io.StringIO(newline="")
    csv.writer(head).writerow(df.columns)
    write_joined(csv_lines(df), path, "\ufeff" + head.getvalue(), "\r\n")


def save_results(df: DataFrame, folder: str, name: str | None = None, source: str | None = None) -> str:
    """Write one CSV into a folder under a given or a generated name; its path."""
    name = name or output_name(source)
    path = f"{folder.rstrip('/')}/{name if name.endswith('.csv') else name + '.csv'}"
    write_csv_bom(df, path)
    return path


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row (value); NaN, which JSON lacks, is null."""
    clean = [F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def respond(df: DataFrame, kind: str, path: str) -> str:
    """Write a batch of results as csv, json (an array) or xlsx."""
    df = whole_scores(df)
    if kind == "csv":
        write_csv_bom(df, path)
    elif kind == "json":
        write_joined(json_rows(df), path, "[", ",\n", "]", keep_last=False)
    elif kind == "xlsx":
        write_workbook(df, path, "Validation Results")
    else:
        raise ValueError(f"unknown format: {kind}; csv, json and xlsx are written")
    return path
