"""Tables in the shared folder: cutting lineage, and global order without a global task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="rubrica-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, of any store that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None, group_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and survives executors.

    Parquet's writer and reader hold a row group in memory, and look at its size after a hundred rows first: `group_rows` bounds the groups of tables whose rows are megabytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rubrica-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


#: Rows of a staged table that one broadcast may hold.
BROADCAST_ROWS = 50_000


def bounded(table: DataFrame) -> DataFrame:
    """A staged table, which no join broadcasts if it has many rows: Spark goes by the size of files, which tells little of what they hold once read."""
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table


def drop(*tables: DataFrame) -> None:
    """Delete tables that stage() wrote, once nothing reads them any more."""
    for table in tables:
        delete(table.sparkSession, table.staged_at)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with its 0-based place in the given order: range partitions, and the rows before each of them."""
    tie, place, part, before = (f"{name}_{x}" for x in ("tie", "place", "part", "before"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    placed = stage(ranged.withColumn(place, F.monotonically_increasing_id()), "numbered")
    partition = F.shiftright(place, 33)
    sizes = placed.groupBy(partition.alias(part)).count()
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition
    offsets = sizes.select(part, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    at = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before)
    return placed.withColumn(part, partition).join(F.broadcast(offsets), part).withColumn(name, at).drop(part, place, before)
