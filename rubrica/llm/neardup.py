"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

Every text is a weighted set of five-word shingles (words as in decontamination, lower-cased; a text of
fewer words is one shingle). A weight is tf * idf. Document frequencies are counted over all documents into
2**20 hashed counters, whose noise is a fixed share of the documents at every corpus size; idf is scaled
to 1 (a shingle in every document) .. 2 (one no commoner than that noise), so boilerplate counts half.
Consistent weighted samples (r, c ~ Gamma(2,1), beta ~ U(0,1)) form 10 bands of 3; texts that share a band
are candidates. Candidates are verified on whole texts: they link if the TF-IDF weighted Jaccard similarity,
or the plain Jaccard similarity of their shingles, reaches the threshold. (Within a large group of copies
the shared shingles are common and the edits rare, so TF-IDF weights alone would tear such groups.)

Equal texts are one node from the start. In each bucket all members are compared with its most popular
member. In buckets that still hold several components, a text's shingles that occur in no other such text
bound its similarity to all of them: most are ruled out at once. The rest get 16, 1024, 65536, ... more centres
until every pair across components that the bounds allow was compared, so no candidate link between
different texts is lost, while a group that is already one component costs no further pairs. A pair's bound
adds to the shingles that each text has alone a parity sketch of the others: two sketches differ in at most
as many bits as the texts have differing shingles, so a pair it rules out has no link. The bound is exact at
every length; it rules out little once texts differ in many more shingles than the sketch has bits (512).

Defined results: each null text is a class of its own; wordless texts (the empty one too) are duplicates of
equal texts only; repeated rows belong to one class; class_id is the least doc_id of the class (null if
all are null); an empty table gives no rows. Extra columns are ignored by classes() and kept by keep_one().
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import VECTOR_SCHEMA, Words, alnum_bytes, byte_table, flat_text, fresh, grams, mix, slices, stage, sum_vectors, table, task_id, vector_rows, whole_grams
from rubrica.llm.graph import components, merged

SHINGLE, THRESHOLD, BANDS, ROWS, BUCKET_BITS = 5, 0.8, 10, 3, 20
LOW = np.uint64((1 << 44) - 1)
SKETCH_WORDS = 8
SKETCH = tuple(f"sketch{i}" for i in range(SKETCH_WORDS))
MEASURES = ("count", "weight", "count_in", "weight_in", *SKETCH)


def shingles(column: pa.Array, hasher: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 44-bit shingle, tf) of a slice, sorted by row and shingle."""
    data, offsets = flat_text(column)
    words, _, _, first, counts = hasher.hashes(data, offsets)
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), np.maximum(counts - k + 1, 0))
    keys = grams(words, k)[whole_grams(counts, k)]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        few = [grams(words[first[i] : first[i] + counts[i]], int(counts[i]))[0] for i in short]
        rows, keys = np.append(rows, short.astype(np.uint64)), np.append(keys, np.array(few, np.uint64))
    packed = np.sort((rows << np.uint64(44)) | (keys & LOW))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    packed = packed[at]
    return (packed >> np.uint64(44)).astype(np.int64), packed & LOW, np.diff(np.append(at, len(new)))


def idf_table(counters: np.ndarray, n_docs: int) -> np.ndarray:
    """idf of each counter, scaled from 1 (in every document) to 2 (as common as the mean counter)."""
    span = np.log((n_docs + 1) / (counters.mean() + 1))
    if span <= 0:
        return np.full(len(counters), 2, np.float32)
    return (1 + np.clip(np.log((n_docs + 1) / (counters + 1)) / span, 0, 1)).astype(np.float32)


def samples(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n consistent weighted samples of every row that has shingles: (rows, samples[row, n])."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    out = np.empty((len(starts), n), np.uint64)
    lengths = np.diff(np.append(starts, len(rows)))
    log_s = np.log(weights).astype(np.float32)
    rng = np.random.default_rng(seed)
    low16, unit = np.uint64(0xFFFF), np.float32(1 / 65536)
    owner = np.repeat(np.arange(len(starts)), lengths)
    for j in range(n):
        a, b = (np.uint64(x) | np.uint64(1) for x in rng.integers(1, 2**63, 2, dtype=np.uint64))
        x = keys * a
        x ^= x >> np.uint64(29)
        x *= b
        x ^= x >> np.uint64(32)
        u = x.view(np.uint16).reshape(-1, 4).astype(np.float32)
        u += np.float32(0.5)
        u *= unit
        r = -np.log(u[:, 0] * u[:, 1])
        log_c = np.log(-np.log(u[:, 2] * u[:, 3]))
        y = x * np.uint64(0x9E3779B97F4A7C15)
        beta = (y >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_s / r + beta)
        log_a = log_c - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(log_a, starts) if len(starts) else log_a
        at = np.flatnonzero(log_a == least[owner])
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
        out[:, j] = mix(keys[at] + (t[at].astype(np.int64).astype(np.uint64) << np.uint64(45)) + np.uint64(j))
    return rows[starts], out


def band_keys(signature: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for j in range(b * per_band, (b + 1) * per_band):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, j])
        out[:, b] = key
    return out.view(np.int64)


def similarity(a: str, b: str, idf: np.ndarray, hasher: Words) -> float:
    """The larger of the TF-IDF weighted and the plain Jaccard similarity of two texts."""
    rows, keys, tf = shingles(pa.array([a, b]), hasher)
    weight = tf * idf[(keys & np.uint64(len(idf) - 1)).astype(np.int64)]
    cut = int(np.searchsorted(rows, 1))
    if cut in (0, len(rows)):
        return 0.0
    _, i, j = np.intersect1d(keys[:cut], keys[cut:], assume_unique=True, return_indices=True)
    low = np.minimum(weight[:cut][i], weight[cut:][j]).sum()
    return max(float(low / (weight.sum() - low)), len(i) / (len(keys) - len(i)))


class NearDuplicates:
    """The stages of the operator over one table of documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS) -> None:
        self.docs = docs.select("doc_id", "text")
        self.spark: SparkSession = docs.sparkSession
        self.threshold, self.bands, self.per_band = threshold, bands, per_band
        self.values = byte_table(alnum_bytes(), 10)
        self.id_type = dict(self.docs.dtypes)["doc_id"]
        self.idf = self.spark.sparkContext.broadcast(self.frequencies())
        self.signed = self.signatures()

    def frequencies(self) -> np.ndarray:
        values, size = self.values, 1 << BUCKET_BITS

        def count(batches):
            hasher, total = Words(values), np.zeros(size, np.int64)
            for whole in batches:
                for batch in slices(whole, "text"):
                    _, keys, _ = shingles(batch.column("text"), hasher)
                    total += np.bincount((keys & np.uint64(size - 1)).astype(np.int64), minlength=size)
            yield vector_rows(task_id(), total)

        texts = self.docs.select("text")
        counters = sum_vectors(texts.mapInArrow(count, VECTOR_SCHEMA), texts.rdd.getNumPartitions(), size, "int64")
        return idf_table(counters, self.docs.count())

    def signatures(self) -> DataFrame:
        """(doc_id, node, bands): node is the text's digest, null for a null text."""
        values, idf, bands, per_band = self.values, self.idf, self.bands, self.per_band

        def sign(batches):
            hasher = Words(values)
            for whole in batches:
                for batch in slices(whole, "text"):
                    column = batch.column("text")
                    rows, keys, tf = shingles(column, hasher)
                    weight = tf * idf.value[(keys & np.uint64(len(idf.value) - 1)).astype(np.int64)]
                    have, signature = samples(rows, keys, weight, bands * per_band)
                    got = [None] * len(column)
                    for row, key in zip(have.tolist(), band_keys(signature, bands, per_band).tolist(), strict=True):
                        got[row] = key
                    data, offsets = flat_text(column)
                    data = data.tobytes()
                    valid = column.is_valid().to_pylist()
                    nodes = [hashlib.md5(data[a:b]).digest() if v else None for v, a, b in zip(valid, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

        return stage(self.docs.mapInArrow(sign, f"doc_id {self.id_type}, node binary, bands array<long>"), "signatures")

    def buckets(self) -> DataFrame:
        """(band, node, size, popular) of the distinct texts in buckets of two or more."""
        texts = self.signed.where("bands is not null").groupBy("node").agg(F.first("bands").alias("bands"))
        members = stage(texts.select("node", F.explode("bands").alias("band")), "bands")
        sizes = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
        shared = stage(members.join(sizes, "band"), "buckets")
        popular = shared.groupBy("node").agg(F.sum("size").alias("popular"))
        return stage(shared.join(popular, "node"), "buckets")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        values, idf, threshold = self.values, self.idf, self.threshold

        def check(batches):
            hasher = Words(values)
            for batch in (part for whole in batches for part in slices(whole, "text_a")):
                keep = [similarity(a, b, idf.value, hasher) >= threshold for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b")
        return full.mapInArrow(check, "a binary, b binary")

    def texts(self, buckets: DataFrame) -> DataFrame:
        """(node, text) of all texts in buckets, each fetched through one document."""
        nodes = buckets.select("node").distinct()
        chosen = self.signed.where("bands is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node")
        digest = self.docs.where("text is not null").withColumn("node", F.unhex(F.md5("text")))
        found = digest.join(chosen.withColumnRenamed("node", "n").withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("n")))
        return stage(found.groupBy("node").agg(F.first("text").alias("text")), "texts")

    def labels(self) -> DataFrame | None:
        """(node, label) of the texts that have a link to a different text."""
        buckets = self.buckets()
        if buckets.isEmpty():
            return None
        texts = self.texts(buckets)
        ordered = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        centres = buckets.groupBy("band").agg(F.max(F.struct("popular", "node"))["node"].alias("x"))
        pairs = stage(ordered(buckets.select("band", F.col("node").alias("y")).join(centres, "band").where("x != y")), "pairs")
        labels = components(stage(self.verified(pairs, texts), "links"))
        open_ = stage(self.open_members(buckets, labels), "open")
        if open_.isEmpty():
            return labels
        open_ = stage(open_.join(self.shareable(open_, texts), "node"), "open")
        compared, width = pairs, 16
        while True:
            now = stage(self.open_members(open_.drop("label", "n"), labels), "open")
            largest = now.agg(F.max("n")).first()[0]
            if largest is None:
                return labels
            chosen = now.where(F.pmod(F.xxhash64("band", "node", F.lit(width)), F.col("n")) < width)
            chosen = chosen.select("band", *[F.col(c).alias(f"{c}_x") for c in ("node", "label", *MEASURES)])
            crossing = now.select("band", *[F.col(c).alias(f"{c}_y") for c in ("node", "label", *MEASURES)]).join(chosen, "band")
            crossing = crossing.where(F.col("label_x") != F.col("label_y")).where(self.can_link("count", "count_in") | self.can_link("weight", "weight_in"))
            more = stage(ordered(crossing.select(F.col("node_x").alias("x"), F.col("node_y").alias("y"))).join(compared, ["a", "b"], "left_anti"), "pairs")
            found = stage(self.verified(more, texts), "links")
            compared, labels = compared.union(more), merged(labels, found)
            if width >= largest:
                return labels
            width *= 64

    def open_members(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, with label and bucket size n."""
        now = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        spread = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo != hi")
        return now.join(spread.select("band", "n"), "band")

    def shareable(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """(node, *MEASURES) of the members that can have a link at all.

        *_in is the part of a text's shingles that occurs in another member too. No overlap exceeds it, so
        the similarity to a text of size n is at most in / (size + n - in). SKETCH holds their parities.
        """
        values, idf, threshold = self.values, self.idf, self.threshold

        def spread(batches):
            hasher = Words(values)
            for whole in batches:
                for batch in slices(whole, "text", 1 << 19):
                    rows, keys, tf = shingles(batch.column("text"), hasher)
                    weight = tf * idf.value[(keys & np.uint64(len(idf.value) - 1)).astype(np.int64)].astype(float)
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), pa.array(keys.astype(np.int64)), pa.array(weight)], ["node", "key", "w"])

        found = texts.join(members.select("node").distinct(), "node", "left_semi").mapInArrow(spread, "node binary, key long, w double")
        found = stage(found, "shingles")
        common = found.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key", F.lit(1).alias("common"))
        inside = lambda c: F.sum(F.when(F.col("common").isNotNull(), c).otherwise(F.lit(0)))
        bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
        parity = [F.bit_xor(F.when(F.col("common").isNotNull() & F.expr(f"(key >> 6) & {SKETCH_WORDS - 1} = {i}"), bit).otherwise(F.lit(0))).alias(c) for i, c in enumerate(SKETCH)]
        sizes = found.join(common, "key", "left").groupBy("node").agg(F.count("*").alias("count"), F.sum("w").alias("weight"), inside(F.lit(1)).alias("count_in"), inside(F.col("w")).alias("weight_in"), *parity)
        return sizes.where((F.col("count_in") >= threshold * F.col("count")) | (F.col("weight_in") >= (threshold - 1e-9) * F.col("weight")))

    def can_link(self, size: str, inner: str):
        """Neither text's shareable part rules out the threshold, nor does what the two certainly differ in.

        Sets of sizes m and n that differ in d have the similarity (m + n - d) / (m + n + d); no weight is below 1.
        """
        reach = lambda a, b: F.col(f"{inner}_{a}") * (1 + 1 / self.threshold) - F.col(f"{size}_{a}") >= F.col(f"{size}_{b}") - 1e-6
        both, shared = (F.col(f"{c}_x") + F.col(f"{c}_y") for c in (size, inner))
        bits = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in SKETCH])
        close = both - shared + bits <= both * ((1 - self.threshold) / (1 + self.threshold)) + 1e-6
        return reach("x", "y") & reach("y", "x") & close

    def classes(self) -> DataFrame:
        """(doc_id, node, label, class_id): a null text has no label and its own doc_id as class."""
        labels = self.labels()
        rows = self.signed.select("doc_id", "node")
        rows = rows.withColumn("label", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("doc_id", "node", "label")
        rows = stage(rows, "rows")
        least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"))
        return rows.join(least, "label", "left").select("doc_id", "node", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id), one row per document."""
    return NearDuplicates(docs, threshold).classes().select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of docs without all but the first of each class; columns stay as they are."""
    rows = NearDuplicates(docs, threshold).classes()
    key, id_, node = fresh(docs, "kept_key", "kept_id", "kept_node")
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("f")).select(F.col("f.doc_id").alias(id_), F.col("f.node").alias(node))
    keyed = docs.where("text is not null").withColumn(key, F.unhex(F.md5("text")))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(node)), "left_semi").dropDuplicates(["doc_id", key])
    return kept.drop(key).unionByName(docs.where("text is null"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
