"""What outlives a batch: photos that directories remember, and calls that ids have used.

State is a log in a shared folder, a part for each batch, in buckets of the key that is looked up. Batches are numbered in their order; a batch sees the parts before its own
and writes its own part whole, so running it again replaces what it wrote and charges or remembers nothing twice. A batch reads only the buckets that its own
keys fall into. One batch runs at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrica.functions.scalars import hamming
from rubrica.operators.duplicates import KNOWN, blocks
from rubrica.operators.quota import SALTS
from rubrica.plans.staging import delete, exists, stage


class BatchLog:
    """Rows of `schema` by batch and bucket of their key columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def write(self, batch: int, df: DataFrame) -> None:
        spread = self.bucketed(df).repartition("bucket")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={batch}")

    def before(self, batch: int, keys: DataFrame | None = None) -> DataFrame:
        """The rows of earlier batches, of the buckets of `keys` only."""
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], f"{self.schema}, batch long, bucket int")
        rows = self.spark.read.schema(f"{self.schema}, batch long, bucket int").option("basePath", self.folder).parquet(self.folder).where(F.col("batch") < batch)
        if keys is None:
            return rows
        wanted = [r["bucket"] for r in self.bucketed(keys).select("bucket").distinct().collect()]  # at most as many as there are buckets
        return rows.where(F.col("bucket").isin(wanted)) if wanted else rows.limit(0)

    def forget(self, batch: int) -> None:
        """Undo a batch."""
        delete(self.spark, f"{self.folder}/batch={batch}")


class PhotoIndex:
    """Photos that directories remember, found by their bytes and by pieces of their hash.

    A photo has a row for its bytes, and one for every choice of pieces that a hash within the threshold must share one of; rows meet by equality alone,
    which loses no near hash. The bytes' own hash is stored once, as the value of slot -1. clear() forgets what a directory, or all of them, remember so far.
    """

    ROW = "slot int, value string, key string, phash string, path string, submission string, ord long, pos long"

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 5, buckets: int = 64) -> None:
        self.spark, self.threshold, self.cleared = spark, threshold, f"{folder.rstrip('/')}/cleared"
        self.pieces = blocks(threshold, min(16, threshold + 2))
        self.log = BatchLog(spark, f"{folder.rstrip('/')}/photos", self.ROW, ["key", "slot", "value"], buckets)

    def slots(self, df: DataFrame) -> DataFrame:
        """A row for each way in which a photo can be found."""
        part = lambda slot, value: F.struct(F.lit(slot).alias("slot"), value.alias("value"))
        near = [part(i, F.concat(*[F.substring("phash", a, n) for a, n in spans])) for i, spans in enumerate(self.pieces)]
        return df.select("*", F.inline(F.array(part(-1, F.col("sha256")), *near))).where("value is not null")

    def add(self, batch: int, photos: DataFrame) -> None:
        """Remember photos (submission, ord, pos, key, sha256, phash, path) of a batch, in place of what it remembered before."""
        text, number = (lambda kind: lambda c: F.col(c).cast(kind).alias(c)), ["ord", "pos"]
        rows = photos.where("sha256 is not null").select(*[text("string")(c) for c in ("key", "sha256", "phash", "path", "submission")], *[text("long")(c) for c in number])
        self.log.write(batch, self.slots(rows).select(*[c.split()[0] for c in self.ROW.split(", ")]))

    def lookup(self, batch: int, images: DataFrame) -> DataFrame:
        """images with known_exact and known_near: what their directory remembers from before this batch, the first of each; equal photos are looked up once."""
        asked = images.where("sha256 is not null").select(F.col("key").cast("string").alias("key"), "sha256", "phash").distinct()
        probes = stage(self.slots(asked), "probes")
        known = self.log.before(batch, probes).select(F.col("key"), "slot", "value", F.col("phash").alias("known"), "path", F.struct("batch", "ord", "pos").alias("since"))
        met = probes.join(known, ["key", "slot", "value"])
        if exists(self.spark, self.cleared):
            gone = self.spark.read.schema("key string, upto long").parquet(self.cleared)
            everything = gone.where("key is null").agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("upto")).first()["upto"]
            met = met.where(F.col("since.batch") > everything).join(gone.where("key is not null").groupBy("key").agg(F.max("upto").alias("upto")), "key", "left")
            met = met.where(F.col("upto").isNull() | (F.col("since.batch") > F.col("upto"))).drop("upto")
        distance = hamming(F.col("phash"), F.col("known"))
        near = (F.col("slot") >= 0) & (distance <= self.threshold)
        first = lambda which, what: F.min_by(F.when(which, what), F.when(which, F.col("since")))
        found = met.groupBy("key", "sha256", "phash").agg(
            first(F.col("slot") == -1, F.col("path")).alias("known_exact"), first(near, F.struct("path", distance.cast("int").alias("distance")).cast(KNOWN)).alias("known_near")
        )
        found = stage(found.where("known_exact is not null or known_near is not null"), "known")
        same = (images["key"].cast("string") == found["key"]) & (images["sha256"] == found["sha256"]) & images["phash"].eqNullSafe(found["phash"])
        return images.join(found, same, "left").select(*[images[f"`{c}`"] for c in images.columns], "known_exact", "known_near")

    def clear(self, batch: int, key: str | None = None) -> None:
        """Forget what one directory (or all) remembers from batches up to this one."""
        self.spark.createDataFrame([(key, batch)], "key string, upto long").write.mode("append").parquet(self.cleared)


class BudgetLedger:
    """Calls that ids have used, by batch."""

    def __init__(self, spark: SparkSession, folder: str, max_calls: int = 5, buckets: int = 64) -> None:
        self.spark, self.max_calls = spark, max_calls
        self.log = BatchLog(spark, folder, "id string, used long", ["id"], buckets)

    def used(self, batch: int, ids: DataFrame | None = None) -> DataFrame:
        """(id, used) before a batch, as texts; of the buckets of some ids (id) only."""
        keys = None if ids is None else ids.select(F.col("id").cast("string").alias("id"))
        return self.log.before(batch, keys).groupBy("id").agg(F.sum("used").alias("used"))

    def last_granted(self, batch: int, calls: DataFrame) -> DataFrame:
        """(id, cut) of the ids of calls(id, idx, step) with a call left: the last one within the budget. The calls granted are charged to this batch.

        No task sees more than its share of an id's calls: each keeps max_calls of them, and an id's own limit follows.
        """
        order = ["idx", "step"]
        rank = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        salted = calls.select("id", *order).withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        few = salted.withColumn("n", rank(["id", "salt"])).where(F.col("n") <= self.max_calls)
        few = stage(few.withColumn("n", rank(["id"])).where(F.col("n") <= self.max_calls), "few")
        before = self.used(batch, few).withColumnRenamed("id", "known_id")
        left = few.join(before, F.col("id").cast("string") == F.col("known_id"), "left").where(F.col("n") <= self.max_calls - F.coalesce("used", F.lit(0)))
        out = stage(left.groupBy("id").agg(F.max(F.struct(*order)).alias("cut"), F.count("*").alias("charged")), "granted")
        self.log.write(batch, out.where("id is not null").select(F.col("id").cast("string").alias("id"), F.col("charged").alias("used")))
        return out.drop("charged")

    def granted(self, batch: int, calls: DataFrame) -> DataFrame:
        """calls with whether each is granted, after what earlier batches have used; calls are read twice, so staged."""
        calls = stage(calls, "calls")
        within: Column = F.coalesce(F.struct("idx", "step") <= F.col("cut"), F.lit(False))
        return calls.join(self.last_granted(batch, calls), "id", "left").withColumn("granted", within).drop("cut")

    def summary(self, batch: int) -> DataFrame:
        """(id, used, max_calls, remaining) after the batches before this one."""
        sums = self.used(batch)
        return sums.select("id", "used", F.lit(self.max_calls).alias("max_calls"), F.greatest(F.lit(0), self.max_calls - F.col("used")).alias("remaining"))
