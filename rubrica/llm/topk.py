"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components become whole numbers floor(scale * x). The dimensions are cut into `lists`: each is a column of its own, and within one
list every query has a local score for every vector, the inner product of their parts there. The score is the sum over lists.

1. Each task gathers the best local scores of its part of one list. What they name is looked up, and the k-th best full score is a lower bound
   of the answer's last score. (Partial sums alone bound nothing here, since a missing local score may be negative.)
2. That bound divided by the lists of the query is the cutoff, which is broadcast. A vector below the cutoff in all lists is below the bound, so
   only entries at or above it are collected; a tie at the bound counts only up to the id of the k-th.
3. Sums with an entry from every list are exact and raise the bound. What is incomplete and can still reach it is looked up and scored exactly.

Equal vectors are one class with its k + 1 least ids, which suffice for every query; Spark limits them before they are shuffled. Equal queries are
answered once. Queries come in blocks of `block_bytes` of vectors at most, for which every list is scanned; only a block's vectors and cutoffs are
broadcast, and its entries stay in the shared folder.

Defined results: vectors that are null or hold null, NaN or infinite components take no part. Shorter vectors count as padded with zeros; an empty
vector scores 0. Rows with one id are rows of their own, and a query leaves out one row, its own. Rows without an id ask nothing, and follow all ids
among equals. Local scores beyond 2**61 are clipped there. Empty tables give no rows, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrica.llm.common import drop, stage, table

#: Vectors and queries of one matrix product.
TILE = 2048, 1024
NO_ID = 2**63 - 1
EXACT, WIDE, CLIP = 2**52, 2**62, 2**61
ENTRY = "q long, cls long, first long, list int, score long, need int, bound long"


def whole(vector: Column, scale: int) -> Column:
    """Components as whole numbers; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` whole numbers; short ones are padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def inner(a: np.ndarray, b: np.ndarray, rows: bool = False) -> np.ndarray:
    """Inner products of all rows of a with all of b, or row by row; exact in any of three number types, by the largest possible sum."""
    if not a.size or not b.size:
        return np.zeros(len(a) if rows else (len(a), len(b)), np.int64)
    most = float(max(-float(a.min()), float(a.max()))) * float(max(-float(b.min()), float(b.max()))) * a.shape[1]
    kind = np.float64 if most < EXACT else np.int64 if most < WIDE else object
    a, b = a.astype(kind), b.astype(kind)
    got = (a * b).sum(axis=1) if rows else a @ b.T
    return got if kind is np.float64 else np.clip(got, -CLIP, CLIP).astype(np.int64)


def best(rows: np.ndarray, score: np.ndarray, first: np.ndarray, cls: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row: highest score, then least id."""
    order = np.lexsort((cls, first, -score, rows))
    r = rows[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return order[rank < k]


class Block:
    """Queries of one block: their classes, and their part of each list."""

    def __init__(self, rows: list, lists: int, widths: list[int]) -> None:
        self.ids = np.array([r["cls"] for r in rows], np.int64)
        self.parts = [matrix(pa.array([r[f"part{b}"] for r in rows], pa.list_(pa.int64())), widths[b]) for b in range(lists)]
        self.widths = widths
        active = np.array([(p != 0).any(axis=1) for p in self.parts])
        active[0] |= ~active.any(axis=0)  # a query of zeros has one list, of equal scores
        self.active, self.need = active, active.sum(axis=0).astype(np.int64)
        self.bound = np.full(len(rows), -NO_ID)
        self.last = np.full(len(rows), NO_ID)

    def tiles(self, batch: pa.RecordBatch, part: str, b: int) -> Iterator[tuple]:
        """Local scores of list b, as (first query, first vector, scores) for one tile after the other."""
        x = matrix(batch.column(part), self.widths[b])
        for at in range(0, len(x), TILE[0]):
            for q in range(0, len(self.ids), TILE[1]):
                yield q, at, inner(self.parts[b][q : q + TILE[1]], x[at : at + TILE[0]])


def entries(block: Block, b: int, q: np.ndarray, cls: np.ndarray, first: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    n = len(q)
    columns = [block.ids[q], cls, first, np.full(n, b, np.int32), score.astype(np.int64), block.need[q].astype(np.int32), block.bound[q]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in ENTRY.split(", ")])


def gather(block, b: int, k: int):
    """Phase 1: the k best local scores of list b among a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        kept = [np.zeros(0, np.int64) for _ in range(4)]  # query, score, first, class
        floor = np.where(own.active[b], -NO_ID, NO_ID)
        for batch in batches:
            ids, classes = batch.column("first").to_numpy(), batch.column("cls").to_numpy()
            for q, at, score in own.tiles(batch, f"part{b}", b):
                low = floor[q : q + TILE[1]]
                if score.shape[1] > k and (low == -NO_ID).any():
                    low = np.maximum(low, np.partition(score, score.shape[1] - k, axis=1)[:, -k].astype(np.int64))
                r, c = np.nonzero((score >= low[:, None]) & own.active[b][q : q + TILE[1], None])
                new = (r + q, score[r, c].astype(np.int64), ids[at + c], classes[at + c])
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                place = best(*kept, k)
                kept = [x[place] for x in kept]
                count = np.bincount(kept[0], minlength=len(floor))
                full = np.flatnonzero(count >= k)
                floor[full] = kept[1][np.cumsum(count)[full] - 1]
        yield entries(own, b, kept[0], kept[3], kept[2], kept[1])

    return run


def collect(block, b: int):
    """Phase 2: the entries of list b that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        for batch in batches:
            ids, classes = batch.column("first").to_numpy(), batch.column("cls").to_numpy()
            for q, at, score in own.tiles(batch, f"part{b}", b):
                rows = slice(q, q + TILE[1])
                scaled, bound = score * own.need[rows, None], own.bound[rows, None]
                there = (scaled > bound) | (scaled == bound) & (ids[None, at : at + score.shape[1]] <= own.last[rows, None])
                r, c = np.nonzero(there & own.active[b][rows, None])
                if len(r):
                    yield entries(own, b, r + q, classes[at + c], ids[at + c], score[r, c])

    return run


def resolve(block):
    """Full scores of pairs (q, cls, first, part0, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        order = np.argsort(own.ids)
        for batch in batches:
            at = order[np.searchsorted(own.ids, batch.column("q").to_numpy(), sorter=order)]
            score = sum(inner(part[at], matrix(batch.column(f"part{b}"), part.shape[1]), rows=True).astype(np.int64) for b, part in enumerate(own.parts))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("cls"), batch.column("first"), pa.array(score, pa.int64())], ["q", "cls", "first", "score"])

    return run


def classes_of(rows: DataFrame, k: int, lists: int, step: int) -> DataFrame:
    """(cls, first, ids, part0, ...) of distinct vectors `v`: their k least ids, and their part of each list; staged."""
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k)
    groups = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    parts = [F.slice("v", b * step + 1, step).alias(f"part{b}") for b in range(lists)]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = groups.repartition(n).select(F.monotonically_increasing_id().alias("cls"), F.col("ids")[0].alias("first"), "ids", "v", *parts)
    return stage(spread, "classes")


def answered(spark: SparkSession, classes: DataFrame, asked: DataFrame, lists: int, widths: list[int], k: int) -> DataFrame:
    """(q, cls, first, score), staged: the k best classes of each query of one block."""
    parts = [f"part{b}" for b in range(lists)]
    own = Block(asked.select("cls", *parts).collect(), lists, widths)
    if not len(own.ids):
        return spark.createDataFrame([], "q long, cls long, first long, score long")
    sent = spark.sparkContext.broadcast(own)
    union = lambda frames: reduce(DataFrame.unionAll, frames)
    lookup = lambda pairs, by: pairs.join(classes.select("cls", *parts), "cls").select("q", "cls", "first", *parts).mapInArrow(resolve(by), "q long, cls long, first long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "cls"))
    local = union([classes.select("cls", "first", part).mapInArrow(gather(sent, b, k), ENTRY) for b, part in enumerate(parts)])
    known = lookup(local.select("q", "cls", "first").distinct(), sent)
    kth = known.withColumn("n", rank).where(F.col("n") <= k).where(F.col("n") == k).select("q", "score", "first").collect()  # a row per query of the block
    order = {q: i for i, q in enumerate(own.ids.tolist())}
    for row in kth:
        own.bound[order[row["q"]]], own.last[order[row["q"]]] = row["score"], row["first"]
    cut = spark.sparkContext.broadcast(own)
    above = union([classes.select("cls", "first", part).mapInArrow(collect(cut, b), ENTRY) for b, part in enumerate(parts)])
    sums = stage(above.groupBy("q", "cls", "first", "need", "bound").agg(F.sum("score").alias("score"), F.count("*").alias("lists")), "sums")
    whole_sums = sums.where("lists = need").select("q", "cls", "first", "score")
    raised = whole_sums.withColumn("n", rank).where(F.col("n") <= k).where(F.col("n") == k).select("q", F.col("score").alias("raised"))
    missing = F.floor(F.col("bound") / F.col("need")) + 1  # above what a list without an entry can add, whatever the division rounds
    most = F.col("score") + (F.col("need") - F.col("lists")) * missing
    open_ = sums.where("lists < need").join(F.broadcast(raised), "q", "left").where(F.greatest("bound", "raised") <= most)
    found = whole_sums.unionByName(lookup(open_.select("q", "cls", "first"), cut))
    out = stage(found.withColumn("n", rank).where(F.col("n") <= k).drop("n"), "answers")
    drop(sums)
    return out


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, lists: int = 2, block_bytes: int = 1 << 24, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is a query, the k other rows of the highest inner product, ties to the smaller id."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(f"`{id_column}`").cast("long").alias("own_id"), whole(F.col(f"`{vector}`"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    rows = source.select(F.coalesce("own_id", F.lit(NO_ID)).alias("id"), "v", "asks")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    lists = min(lists, width)
    step = -(-width // lists)
    lists = -(-width // step)
    widths = [min(step, width - b * step) for b in range(lists)]
    classes = classes_of(rows.select("id", "v"), k + 1, lists, step)
    asking = stage(rows.where(F.col("asks") & (F.col("id") != NO_ID)).select("id", "v").join(classes.select("cls", "v"), "v").select(F.col("id").alias("query_id"), F.col("cls").alias("q")), "asking")
    asked = stage(classes.join(asking.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi").select("cls", *[f"part{b}" for b in range(lists)]), "asked")
    blocks = -(-asked.count() * width * 8 // block_bytes) or 1
    parts = [answered(spark, classes, asked.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == i), lists, widths, k + 1) for i in range(blocks)]
    ids = reduce(DataFrame.unionAll, parts).join(classes.select("cls", "ids"), "cls").select("q", "cls", "score", F.explode("ids").alias("id"))
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "cls"))).where(F.col("n") <= k + 1)
    lists_of = few.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "cls"))).alias("found"))
    itself = F.expr("array_position(transform(found, x -> x.id = query_id and x.cls = q), true)")
    others = asking.join(lists_of, "q").withColumn("itself", itself).withColumn("found", F.slice(F.filter("found", lambda x, i: i + 1 != F.col("itself")), 1, k))
    told = others.select("query_id", F.posexplode("found").alias("at", "hit"))
    return told.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("hit.id"), F.lit(NO_ID)).alias("vec_id"), (-F.col("hit.less")).alias("score"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""
