"""Global order without a global task: ranks and running totals over range partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.common import stage, task_id


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df in range partitions sorted by `order`; equal rows may lie in different partitions, so a group
    of equal keys of any size is spread. The row number in the scan breaks ties."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with its 0-based position in the given order. df is read twice (range bounds, rows): stage it before."""
    placed = stage(ranged(df, order).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, place).drop("__part", "__place", "__before")


def running(df: DataFrame, group: str, order: list[str], value: str, name: str = "start") -> DataFrame:
    """df with the sum of `value` over the earlier rows of its group (a string column without nulls)."""
    schema = df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def scan(batches):
        part, last, total = task_id(), None, 0
        for batch in batches:
            codes = batch.column(group).dictionary_encode()
            names, idx = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            amount = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(amount) - amount
            for at in np.flatnonzero(np.append(True, idx[1:] != idx[:-1])) if len(idx) else ():
                stop = at + int(np.argmax(np.append(idx[at:] != idx[at], True)))
                carried = total if names[idx[at]] == last else 0
                own = before[at:stop] - before[at] + carried
                last, total = names[idx[at]], int(own[-1] + amount[stop - 1])
                before[at:stop] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(before)], [*batch.schema.names, "__part", "__own"])

    placed = stage(ranged(df, [group, *order]).mapInArrow(scan, fields + ", __part long, __own long"), "running")
    sizes = placed.groupBy(group, "__part").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition and group
    offsets = sizes.select(F.col(group), "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return placed.join(offsets, [group, "__part"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")
