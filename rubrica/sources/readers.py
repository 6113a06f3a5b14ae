"""Tables and listings in: CSV, Excel, JSON rows, folders of images and results."""

from __future__ import annotations

import csv as csv_format
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from rubrica.plans.staging import delete, exists, hadoop_path, stage
from rubrica.sources.workbook import Workbook

IMAGE_GLOB = "*.{jpg,jpeg,png,gif,bmp,tiff,webp,JPG,JPEG,PNG,GIF,BMP,TIFF,WEBP}"
# Cells that read as missing.
NO_VALUE = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: A line of whole cells: no quoted cell goes on in the next line, and no quote stands within a plain cell.
WHOLE_LINE = r'^(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+$'


def line_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a file is UTF-8, and whether every record is a line. Lines are looked at where they lie, in as many tasks as the file has splits."""
    lines = spark.read.text(path).select("value", F.is_valid_utf8("value").alias("fine"))
    whole = (F.col("value") == "") | (F.trim("value") != "") & F.col("value").rlike(WHOLE_LINE)
    got = lines.agg(F.bool_and("fine").alias("fine"), F.bool_and(whole).alias("whole")).first()
    return got["fine"] is not False, got["whole"] is not False


@pandas_udf(T.IntegerType())
def n_cells(lines: pd.Series) -> pd.Series:
    return lines.map(lambda line: len(next(csv_format.reader([line]))))


def typed(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers or floats where all their values are such; one pass for all columns."""
    if not df.columns:
        return df
    tests = {"w": r"^[+-]?\d{1,18}$", "f": r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?inf)$"}
    fits = [F.bool_and(F.col(f"`{c}`").rlike(p)).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, p in tests.items()]
    got = df.agg(*fits).first()
    kind = lambda i: "bigint" if got[f"w{i}"] else "double" if got[f"f{i}"] else "string"
    return df.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(df.columns)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None) -> DataFrame:
    """A CSV batch: UTF-8, else Latin-1; quoted line breaks and rows too short are kept, cells of NO_VALUE are null.

    Without a schema, columns of numbers are numbers. A batch without rows, or with a row that has more cells than the header, is a ValueError. A file whose records
    are lines is read in splits; one with line breaks within cells by one task. Without a schema the cells are parsed once, into a staged table, on which the types are found.
    """
    utf8, lines = line_facts(spark, path)
    encoding = encoding or ("UTF-8" if utf8 else "ISO-8859-1")
    reader = spark.read.option("header", True).option("multiLine", not lines).option("escape", '"').option("encoding", encoding)
    if schema:
        df = reader.schema(schema).csv(path)
    else:
        names = [re.sub("^\ufeff", "", n) for n in reader.csv(path).columns]
        broken = "broken_line"
        while broken in names:
            broken += "_"
        fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, broken]])
        parsed = reader.schema(fields).option("columnNameOfCorruptRecord", broken).csv(path)
        inner = [f"c{i}" for i in range(len(names))]  # names of a file may be none of a table
        rows = stage(parsed.toDF(*inner, "broken"), "csv")
        if not rows.where("broken is not null").where(n_cells("broken") > len(names)).isEmpty():
            raise ValueError(f"{path}: a row has more than {len(names)} cells")
        df = typed(rows.select(*[F.when(~F.col(n).isin(NO_VALUE), F.col(n)).alias(n) for n in inner])).toDF(*names)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet: xlsx by the data source of workbook.py, in ranges of rows; the older xls by pandas on the driver (needs its engine), whose sheets have 65,536 rows at most."""
    if path.lower().endswith(".xls"):
        df = spark.createDataFrame(pd.read_excel(path))
    else:
        spark.dataSource.register(Workbook)
        df = spark.read.format("workbook").load(path)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def read_json_rows(spark: SparkSession, rows: list[dict], schema: T.StructType | str) -> DataFrame:
    """A batch given as a list of objects."""
    return spark.createDataFrame(rows, schema)


def read_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """A batch given as one object a row, in the column `value`."""
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")


def read_batch(spark: SparkSession, path: str, **how) -> DataFrame:
    """A batch by its extension. A missing path is a FileNotFoundError, an unknown kind a ValueError; a folder of CSV parts counts as a file."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if kind == "csv":
        return read_csv(spark, path, **how)
    if kind in ("xlsx", "xls"):
        return read_excel(spark, path)
    raise ValueError(f"unsupported file type: {path}; csv, xlsx and xls are read")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, length, modificationTime) of the images below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(folder)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """CSV results with sizes; the content column is never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.round(F.col("length") / 1048576, 2).alias("mb"), "modificationTime")


def result_path(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of one result by its name, whose folders are ignored; null if there is no such file."""
    base = re.split(r"[/\\]", name)[-1]
    path = f"{folder.rstrip('/')}/{base}"
    if base in ("", ".", ".."):
        return None
    p, fs = hadoop_path(spark, path)
    return path if fs.exists(p) and fs.getFileStatus(p).isFile() else None


def folder_stats(files: DataFrame, *by: str) -> DataFrame:
    """Number and size of files (length), per group."""
    return files.groupBy(*by).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.round(F.sum("length") / 1048576, 2).alias("mb"))


def stale(files: DataFrame, now: Column, max_age_s: int = 86400) -> DataFrame:
    return files.where(F.unix_micros("modificationTime") < F.unix_micros(now) - max_age_s * 1_000_000)


def expire(spark: SparkSession, folder: str, max_age_s: int | None = 86400, now_ms: int | None = None) -> int:
    """Delete the files directly in a folder that are older than max_age_s (all of them for null); the number deleted."""
    if not exists(spark, folder):
        return 0
    p, fs = hadoop_path(spark, folder)
    now_ms = now_ms or spark._jvm.java.lang.System.currentTimeMillis()
    old = [s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and (max_age_s is None or now_ms - s.getModificationTime() > 1000 * max_age_s)]
    for path in old:
        delete(spark, path)
    return len(old)
