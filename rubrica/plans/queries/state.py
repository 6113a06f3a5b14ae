"""Queries of what outlives a batch, and of workbooks: written by one step, read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.operators import judge
from rubrica.operators.state import BudgetLedger, PhotoIndex
from rubrica.plans import bind
from rubrica.plans.queries import c, query, reported
from rubrica.plans.queries.photos import images
from rubrica.plans.queries.quota import CALLS, calls
from rubrica.plans.staging import shared_dir, stage
from rubrica.sources import readers, workbook

#: Rows of even ids came in an earlier batch than those of odd ids.
BATCH = "CAST(id % 2 AS INT)"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@reported("budget_batches", f", {CALLS}, both_batches AS (SELECT *, {BATCH} AS batch, row_number() OVER (PARTITION BY bid ORDER BY {BATCH}, id, step) AS place FROM calls) SELECT bid AS id, id AS idx, step, batch, place <= 5 AS granted FROM both_batches")
def budget_batches(d: DataFrame) -> DataFrame:
    """Two batches one after the other: the second sees what ids have used in the first."""
    made, ledger = stage(calls(d), "calls"), BudgetLedger(d.sparkSession, folder(d.sparkSession, "ledger"))
    parts = [ledger.granted(b, made.where(c("idx") % 2 == b)).withColumn("batch", F.lit(b)) for b in (0, 1)]
    return parts[0].unionByName(parts[1])


@reported("budget_left", f", {CALLS} SELECT CAST(bid AS VARCHAR) AS id, least(count(*), 5) AS used, 5 AS max_calls, greatest(0, 5 - count(*)) AS remaining FROM calls GROUP BY bid")
def budget_left(d: DataFrame) -> DataFrame:
    """What the ids have left after two batches, of which the second runs twice."""
    made, ledger = stage(calls(d), "calls"), BudgetLedger(d.sparkSession, folder(d.sparkSession, "ledger"))
    for b in (0, 1, 1):
        ledger.last_granted(b, made.where(c("idx") % 2 == b))
    return ledger.summary(2)


@images(
    "directory_lookup",
    """, old AS (SELECT * FROM i WHERE ord % 2 = 0), new AS (SELECT * FROM i WHERE ord % 2 = 1),
same AS (SELECT n.file, min_by(o.path, o.ord * 1000 + o.pos) AS known_exact FROM new n JOIN old o ON o.key = n.key AND o.sha256 = n.sha256 GROUP BY n.file),
near AS (SELECT n.file, min_by(o.path, o.ord * 1000 + o.pos) AS near_path, min_by(CAST(hamming(n.phash, o.phash) AS INT), o.ord * 1000 + o.pos) AS near_distance
  FROM new n JOIN old o ON o.key = n.key AND hamming(n.phash, o.phash) <= 5 GROUP BY n.file)
SELECT new.file, known_exact, near_path, near_distance FROM new LEFT JOIN same USING (file) LEFT JOIN near USING (file)""",
)
def directory_lookup(d: DataFrame) -> DataFrame:
    """What directories remember of the photos of even submissions, for those of odd ones."""
    photos = stage(d.drop("has_geotag"), "photos")
    index = PhotoIndex(photos.sparkSession, folder(photos.sparkSession, "directories"))
    index.add(0, photos.where(c("ord") % 2 == 0))
    found = index.lookup(1, photos.where(c("ord") % 2 == 1))
    return found.select("file", "known_exact", c("known_near.path").alias("near_path"), c("known_near.distance").alias("near_distance"))


@query("answer_cache", "SELECT sha256(CAST(event_id AS VARCHAR)) AS key, event_type AS answer FROM events WHERE event_id % 3 < 2")
def answer_cache(spark: SparkSession, d: str) -> DataFrame:
    """Two runs append answers, some of both; one merge; then all events are looked up."""
    cache = judge.AnswerCache(spark, folder(spark, "cache"))
    rows = bind.load(spark, d, "events").select("event_id", F.sha2(c("event_id").cast("string"), 256).alias("key"), c("event_type").alias("answer"))
    cache.add(rows.where("event_id % 3 = 0"))
    cache.add(rows.where("event_id % 3 = 1 or event_id % 6 = 0"))
    cache.compact()
    return cache.known(rows)


@query("scan_workbook", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name || ' <&> \"x\"' || chr(10) || 'line' END AS remark, s_suppkey / 4.0::DOUBLE AS share, s_suppkey % 2 = 0 AS even FROM supplier")
def scan_workbook(spark: SparkSession, d: str) -> DataFrame:
    """A workbook written from supplier, with line breaks, missing cells, numbers and truth values, and read by the data source."""
    path = f"{folder(spark, 'workbook')}.xlsx"
    remark = F.when(c("s_suppkey") % 4 == 0, "N/A").otherwise(F.concat("s_name", F.lit(' <&> "x"\nline')))
    rows = bind.load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", remark.alias("remark"), (c("s_suppkey") / 4).alias("share"), (c("s_suppkey") % 2 == 0).alias("even"))
    workbook.write_workbook(rows.orderBy("s_suppkey"), path)
    return readers.read_excel(spark, path)
