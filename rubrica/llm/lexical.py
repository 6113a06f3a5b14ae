"""Ranked lexical search over a tiered index.

The index has a row per shard, the documents of at most `SHARD_BYTES` of text. A term's postings in a shard are sorted by impact, what a posting can
add to a score before the term's weight, and cut into tiers: the highest first, then four times as many, then the rest. Tiers are columns, so a round reads
only those it needs. Behind each tier stands the term's residual, the highest impact of its lower tiers in that shard.

A block of items is scored shard by shard from the first tier. What its postings add up to is a lower bound of a document's score; the residuals of
the terms not met are what it may still gain. The k-th highest lower bound of all shards is the item's threshold. An item is settled in a shard if every document
there that may still gain stays below the threshold; where that proof is lacking, the item falls through to the next tier, in that shard alone. Below the last
tier nothing is left, so every item ends exact. Shards tell k documents an item at most, and equal scores are cut by id.

Terms are compared by hashes of 64 bits. An item's texts and thresholds go through the driver in blocks of `ITEMS` items or `ITEM_BYTES` of text, and so do the items that
are open in a shard, as a bit each: the index's rows, which are megabytes, stay where they are stored. Postings, documents and shards never do.

Defined results: a null text has no terms; a document without terms is in no count and no result. Repeated rows are documents (or items) of their
own. Equal scores go by ascending id, rows without an id last. An item without known terms, or an empty table, gives no rows. Further columns are
ignored, texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrica.llm.common import Words, alnum_bytes, byte_table, drop, flat_text, slices, stage, table, task_id

SHARD_BYTES, ITEMS, ITEM_BYTES = 1 << 21, 256, 1 << 23
#: Postings of a term in a shard that the first tier takes at least; its share of longer lists; how much the second tier is larger.
LEAST, SHARE, STEP = 32, 16, 4
TIERS = 3
#: Shards in a row group of the stored index, which readers hold in memory as a whole.
GROUP_SHARDS = 2
#: Cells of one matrix of items and documents.
CELLS = 1 << 21
VALUES = byte_table(alnum_bytes(), 13)


@dataclass
class Index:
    """The shards' rows, and the number of documents with terms and of their terms."""

    shards: DataFrame
    documents: int
    terms: int
    id_type: str


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def counted(docs: DataFrame, id_type: str) -> DataFrame:
    """A row per shard with its raw postings (terms sorted by hash; documents and frequencies of each), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = Words(VALUES), task_id() << 32
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                words, _, _, _, counts = hasher.hashes(*flat_text(part.column("text")))
                order = np.argsort(words, kind="stable")  # the documents of a term stay in order
                term, doc = words[order], np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
                both = np.ones(len(term), bool)
                both[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(both)
                tf = np.diff(np.append(first, len(term))).astype(np.int32)
                term, doc = term[first], doc[first]
                start = runs(term)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                blobs = [counts.astype(np.int64), term[start], np.append(start, len(term)).astype(np.int64), doc, tf]
                numbers = [number, int((counts > 0).sum()), int(counts.sum())]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in numbers], ids, *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["shard", "documents", "words", "ids", "n", "terms", "start", "doc", "tf"])
                number += 1

    return stage(docs.mapInArrow(run, f"shard long, documents long, words long, ids array<{id_type}>, n binary, terms binary, start binary, doc binary, tf binary"), "postings", group_rows=GROUP_SHARDS)


def impact_of(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    m = 75 + (25 * n * documents) // words
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


TIER_COLUMNS = ("start", "doc", "impact", "residual")


def tiered(raw: DataFrame, documents: int, words: int, id_type: str) -> DataFrame:
    """The rows of raw postings as rows of the index, staged."""
    blobs = ["id_rank", "terms", "df", *[f"{c}{t}" for t in range(TIERS) for c in TIER_COLUMNS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: B023, E731
                n, terms, start, doc, tf = get("n", np.int64), get("terms", np.uint64), get("start", np.int64), get("doc", np.int32), get("tf", np.int32)
                df = np.diff(start)
                owner = np.repeat(np.arange(len(terms)), df)
                impact = impact_of(tf.astype(np.int64), n[doc], documents, max(1, words))
                order = np.lexsort((-impact, owner))
                doc, impact = doc[order], impact[order].astype(np.int32)
                place = np.arange(len(doc)) - np.repeat(start[:-1], df)
                ids = batch.column("ids").slice(row, 1).flatten()
                rank = np.empty(len(ids), np.int32)
                rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids), dtype=np.int32)
                out, low = [rank, terms, df.astype(np.int32)], np.zeros(len(terms), np.int64)
                for t in range(TIERS):
                    high = df if t == TIERS - 1 else np.minimum(df, np.maximum(LEAST, -(-df // SHARE)) * STEP**t)
                    own = (place >= np.repeat(low, df)) & (place < np.repeat(high, df))
                    rest = np.zeros(len(terms), np.int32)
                    more = high < df
                    rest[more] = impact[(start[:-1] + high)[more]]
                    out += [np.append(0, np.cumsum(high - low)).astype(np.int64), doc[own], impact[own], rest]
                    low = high
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(row, 1), batch.column("ids").slice(row, 1), *[pa.array([x.tobytes()], pa.binary()) for x in out]], ["shard", "ids", *blobs])

    fields = ", ".join(f"{c} binary" for c in blobs)
    return stage(raw.select("shard", "ids", "n", "terms", "start", "doc", "tf").mapInArrow(run, f"shard long, ids array<{id_type}>, {fields}"), "index", group_rows=GROUP_SHARDS)


def build(docs: DataFrame, *, id_column: str = "doc_id") -> Index:
    """Index every document by all its terms."""
    id_type = dict(docs.dtypes)[id_column]
    raw = counted(docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text")), id_type)
    total = raw.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
    documents, words = total["documents"] or 0, total["words"] or 0
    shards = tiered(raw, documents, words, id_type)
    drop(raw)
    return Index(shards, documents, words, id_type)


class Block:
    """The terms of a block of items: which items hold each, with which weight, and the items' thresholds."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        words, _, _, _, counts = Words(VALUES).hashes(*flat_text(pa.array([t for _, t in items], pa.string())))
        self.items = np.array([i for i, _ in items], np.int64)
        self.terms, at = np.unique(words, return_inverse=True)
        cell, times = np.unique(at.astype(np.int64) * len(items) + np.repeat(np.arange(len(items)), counts), return_counts=True)
        self.start = np.searchsorted(cell, np.arange(len(self.terms) + 1) * max(1, len(items)))
        self.holder, self.times = cell % max(1, len(items)), times
        self.weight = np.zeros(len(times), np.int64)
        self.threshold = np.zeros(len(items), np.int64)

    def weigh(self, df: dict[int, int], documents: int) -> None:
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms.view(np.int64).tolist()], np.int64)
        self.weight = self.times * np.repeat(w, np.diff(self.start))


def frequencies(index: Index, block) -> DataFrame:
    """(term, df) of the block's terms in all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = block.value.terms
        for batch in batches:
            for terms, df in zip(batch.column("terms"), batch.column("df"), strict=True):
                found, own, at = np.intersect1d(np.frombuffer(terms.as_py(), np.uint64), wanted, assume_unique=True, return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.frombuffer(df.as_py(), np.int32)[own].astype(np.int64))], ["term", "df"])

    return index.shards.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def scored(get, n_docs: int, block: Block, open_: np.ndarray, tiers: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all documents of a shard for the open items, from so many tiers."""
    row = np.full(len(block.items), -1)
    row[open_] = np.arange(len(open_))
    _, own, at = np.intersect1d(get("terms", np.uint64), block.terms, assume_unique=True, return_indices=True)
    rest = get(f"residual{tiers - 1}", np.int32).astype(np.int64)
    low, up = (np.zeros((len(open_), n_docs), np.int64) for _ in range(2))
    lists = [(get(f"start{t}", np.int64), get(f"doc{t}", np.int32), get(f"impact{t}", np.int32)) for t in range(tiers)]
    for i, j in zip(own.tolist(), at.tolist(), strict=True):
        cells = slice(block.start[j], block.start[j + 1])
        who = row[block.holder[cells]]
        weight = block.weight[cells][who >= 0]
        who = who[who >= 0]
        if not len(who) or not weight.any():
            continue
        if rest[i]:
            up[who] += (weight * rest[i])[:, None]
        for start, doc, impact in lists:
            docs, gain = doc[start[i] : start[i + 1]], impact[start[i] : start[i + 1]].astype(np.int64)
            if len(docs):
                place = who[:, None], docs[None]
                low[place] += weight[:, None] * gain
                if rest[i]:
                    up[place] -= (weight * rest[i])[:, None]
    up += low
    return low, up


ANSWER = "item long, shard long, settled boolean, gap long, ids array<{id}>, scores array<long>"


def answers(index: Index, shards: DataFrame, block, tiers: int, k: int) -> DataFrame:
    """For each item that is open in a shard (all, without a column `open`): its best documents there by lower bounds, and the highest upper bound that is no score yet; staged."""
    names = ["shard", "ids", "id_rank", "terms", *[f"{c}{t}" for t in range(tiers) for c in ("start", "doc", "impact")], f"residual{tiers - 1}"]
    has_open = "open" in shards.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[r].as_py(), kind)  # noqa: B023, E731
                ids, rank = batch.column("ids").slice(r, 1).flatten(), get("id_rank", np.int32)
                todo = np.flatnonzero(np.unpackbits(np.array(batch.column("open")[r].as_py(), "<i8").view(np.uint8), bitorder="little")) if has_open else np.arange(len(own.items))
                step, told = max(1, CELLS // max(1, len(ids))), []
                for at in range(0, len(todo), step):
                    some = todo[at : at + step]
                    low, up = scored(get, len(ids), own, some, tiers)
                    gap = np.where(up > low, up, 0).max(axis=1, initial=0)
                    for i, item in enumerate(some.tolist()):
                        least = max(1, int(own.threshold[item]))
                        if len(ids) > k:
                            least = max(least, int(np.partition(low[i], len(ids) - k)[-k]))
                        docs = np.flatnonzero(low[i] >= least)
                        docs = docs[np.lexsort((rank[docs], -low[i][docs]))[:k]]
                        told.append((int(own.items[item]), int(gap[i]), docs, low[i][docs]))
                sizes = np.append(0, np.cumsum([len(d) for _, _, d, _ in told])).astype(np.int32)
                docs, scores = (np.concatenate([t[c] for t in told]) if told else np.zeros(0, np.int64) for c in (2, 3))
                gaps = np.array([g for _, g, _, _ in told], np.int64)
                columns = [pa.array([i for i, _, _, _ in told], pa.int64()), pa.array([batch.column("shard")[r].as_py()] * len(told), pa.int64()), pa.array(gaps == 0), pa.array(gaps)]
                lists = [pa.ListArray.from_arrays(pa.array(sizes), x) for x in (ids.take(pa.array(docs)), pa.array(scores, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *lists], ["item", "shard", "settled", "gap", "ids", "scores"])

    rows = shards.select(*names, *["open"] * has_open)
    return stage(rows.mapInArrow(run, ANSWER.format(id=index.id_type)), "answers")


def bits(places: str, n: int) -> Column:
    """The set of numbers from 0 to n - 1 in a group's column, as whole numbers of 64 bits."""
    return F.array(*[F.coalesce(F.bit_or(F.when(F.expr(f"{places} div 64 = {j}"), F.expr(f"shiftleft(1L, {places} % 64)"))), F.lit(0).cast("long")) for j in range(-(-n // 64))])


def best(found: DataFrame, k: int) -> DataFrame:
    """(item, id, score, rank) of the k best documents of each item."""
    hits = found.select("item", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("item", F.col("hit.ids").alias("id"), F.col("hit.scores").alias("score"))
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return hits.withColumn("rank", order).where(F.col("rank") <= k)


def ranked(index: Index, own: Block, k: int) -> DataFrame:
    """(item, id, score, rank) of one block of items, by as many tiers as the proofs take."""
    spark = index.shards.sparkSession
    df = {r["term"]: r["df"] for r in frequencies(index, spark.sparkContext.broadcast(own)).collect()}  # a row per term of the block
    own.weigh(df, index.documents)
    place = {item: i for i, item in enumerate(own.items.tolist())}
    shards, settled, last = index.shards, None, None
    for tiers in range(1, TIERS + 1):
        got = answers(index, shards, spark.sparkContext.broadcast(own), tiers, k)
        pool = got if settled is None else settled.unionAll(got)
        for r in best(pool, k).where(F.col("rank") == k).select("item", "score").collect():  # a row per item of the block
            own.threshold[place[r["item"]]] = r["score"]
        bounds = F.broadcast(spark.createDataFrame([(i, p, max(1, int(own.threshold[p]))) for i, p in place.items()], "item long, place int, threshold long"))
        proven = got.join(bounds, "item").withColumn("settled", F.col("settled") | (F.col("gap") < F.col("threshold")))
        done = proven.where("settled").select(*got.columns)
        settled = done if settled is None else settled.unionAll(done)
        last = proven.where("not settled").groupBy("shard").agg(bits("place", len(place)).alias("open"))
        shards = index.shards.join(F.broadcast(last), "shard")  # a bit per item of the block and shard of 2 MB
    return best(settled, k)


def search(index: Index, items: DataFrame, *, k: int = 20, id_column: str = "item_id") -> DataFrame:
    """(item_id, rank, id, score): each item's k documents of the highest score above 0, under the item's own column name."""
    spark = items.sparkSession
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_column}`").alias("item_id"), F.col("text")), "items")
    size = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    out = None
    for i in range(blocks):
        texts = numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).select("item", "text").collect()
        if texts:
            found = ranked(index, Block([tuple(r) for r in texts]), k)
            out = found if out is None else out.unionAll(found)
    out = out if out is not None else spark.createDataFrame([], f"item long, id {index.id_type}, score long, rank int")
    return out.join(numbered.select("item", F.col("item_id").alias(id_column)), "item").select(id_column, "rank", "id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


ORACLE = r"""
WITH words AS (SELECT kind, rid, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark)),
freq AS (SELECT kind, rid, id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM freq WHERE kind = 'd' GROUP BY rid),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM freq, totals WHERE kind = 'd' GROUP BY term),
impacts AS (SELECT rid, id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)) AS impact FROM freq JOIN sizes USING (rid), totals WHERE kind = 'd'),
scores AS (SELECT i.rid AS item, i.id AS item_id, d.rid, d.id AS doc_id, CAST(sum(i.tf * w * impact) AS BIGINT) AS score
  FROM freq i JOIN weights USING (term) JOIN impacts d USING (term) WHERE i.kind = 'i' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS n FROM scores WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM ranked WHERE n <= 20
"""
