"""Duplicate photos. images: (submission, ord, pos, key, sha256, phash, path); first means least (ord, pos).

greedy_messages() has the answer of a sequential scan in which a photo is remembered only while its submission has no duplicate. Photos that share bytes or
a near hash, and the photos of one submission, form components, which do not touch each other: each is scanned in order by one task, as a sorted stream.
A component of more than `FOLD_ROWS` photos (one that a third of all submissions share, say) is settled in rounds instead: a photo that has a remembered neighbour before it
is a duplicate, one that has no neighbour before it that may still be remembered is none. There neighbours meet through tables of the earliest photo of each content, hash, and
hash within a directory, so the shared photo costs one row in each of them, and no group is gathered in one task.

Where hashes are crowded (a threshold so wide that a hash has neighbours among random ones) components and pairs would grow with the square of the photos, while few photos are
remembered, for each rules out its neighbours. There the scan goes by blocks of the order: one task scans the first photos, and all others that repeat what it remembers leave at once,
so the next block holds photos that are still open. What photos repeat is looked up among the remembered ones alone.

What earlier batches remember of a directory comes in as columns known_exact (a path) and known_near (path, distance), see operators/state.py; it precedes this batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.functions.scalars import hamming, hash_bits, unequal_nibbles
from rubrica.plans.staging import drop, numbered, stage


def first_holder(images: DataFrame, by: list[str]) -> DataFrame:
    """images with the submission that first held their bytes (within the columns `by`); null for the first itself."""
    first = images.where("sha256 is not null").groupBy(*by).agg(F.min(F.struct("ord", "pos", "submission")).alias("first"))
    is_first = (F.col("first.ord") == F.col("ord")) & (F.col("first.pos") == F.col("pos"))
    return images.join(first, by, "left").withColumn("holder", F.when(~is_first, F.col("first.submission"))).drop("first")


def exact(images: DataFrame) -> DataFrame:
    """Each image with the submission that first held its bytes; null for the first itself."""
    return first_holder(images, ["sha256"])


def in_directory(images: DataFrame) -> DataFrame:
    """As exact(), but only images of one directory key count."""
    return first_holder(images, ["key", "sha256"])


def blocks(threshold: int, pieces: int, length: int = 16) -> list[list[tuple[int, int]]]:
    """Cut a hash into `pieces`; two hashes within the threshold agree on pieces - threshold of them at least.

    Every choice of that many pieces, as (first character, size) each.
    """
    sizes = [length // pieces + (i < length % pieces) for i in range(pieces)]
    spans = [(sum(sizes[:i]) + 1, s) for i, s in enumerate(sizes)]
    return [list(c) for c in combinations(spans, pieces - threshold)]


def best_blocks(threshold: int, n: int, length: int = 16) -> list[list[tuple[int, int]]]:
    """The blocking of n hashes that costs least: rows of the candidate join plus the pairs expected of it."""

    def cost(pieces: int) -> float:
        chars = (length // pieces) * (pieces - threshold)
        return comb(pieces, threshold) * (n + n * n / 16**chars)

    return blocks(threshold, min(range(threshold + 1, length + 1), key=cost), length)


def distinct_hashes(images: DataFrame) -> DataFrame:
    """(phash, bits) of the different hashes, staged, in as many files as a shuffle has partitions."""
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(images.where("phash is not null").select("phash").distinct().withColumn("bits", hash_bits(F.col("phash"))).repartition(n), "hashes")


#: Neighbours that a hash has among random ones from which on hashes count as crowded; hashes that one broadcast holds.
CROWDED, SLICE = 1.0, 100_000


def neighbours(n: int, threshold: int, length: int = 16) -> float:
    """How many of n random hashes are expected within the threshold of one."""
    return n * sum(comb(length, d) * 15**d for d in range(threshold + 1)) / 16**length


def apart(a: str, b: str) -> Column:
    """Differing characters of two columns of hashes whose bits are bits_<column>."""
    quick = unequal_nibbles(F.col(f"bits_{a}"), F.col(f"bits_{b}"))
    return F.when(F.col(f"bits_{a}").isNotNull() & F.col(f"bits_{b}").isNotNull(), quick).otherwise(hamming(F.col(a), F.col(b)))


def side(hashes: DataFrame, name: str) -> DataFrame:
    return hashes.select(F.col("phash").alias(name), F.col("bits").alias(f"bits_{name}"))


def near_to(hashes: DataFrame, few: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance) of each hash and its neighbours among a few others (phash, bits): every pair is compared, by bits where all have them."""
    plain = hashes.where("bits is null").isEmpty()  # the other comparison is not compiled
    distance = unequal_nibbles(F.col("bits_a"), F.col("bits_b")) if plain else apart("a", "b")
    pairs = side(hashes, "a").join(F.broadcast(side(few, "b")), (distance <= threshold) & ((F.col("bits_a") != F.col("bits_b")) if plain else (F.col("a") != F.col("b"))))
    return pairs.select("a", "b", distance.alias("distance"))


def near_hashes(images: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance), a < b: all pairs of different hashes within the threshold."""
    return near_among(distinct_hashes(images), threshold)


def near_among(hashes: DataFrame, threshold: int, crowd: float = CROWDED) -> DataFrame:
    """near_hashes() of hashes that distinct_hashes() staged.

    Hashes meet in an equi-join on choices of their pieces, which loses no pair; how many pieces follows from the number of
    hashes. Crowded ones would meet in more rows than there are pairs: all are compared, in slices. Beyond a threshold of 15 of 16 characters everything matches; that is refused.
    """
    if threshold > 15:
        raise ValueError("a threshold above 15 of 16 characters matches everything")
    n = hashes.count()
    if neighbours(n, threshold) >= crowd:
        slices = max(1, -(-n // SLICE))
        part = F.pmod(F.xxhash64("phash"), F.lit(slices))
        return reduce(DataFrame.unionAll, [near_to(hashes, hashes.where(part == i), threshold).where("a < b") for i in range(slices)])
    chosen = best_blocks(threshold, n)
    keys = [F.concat(F.lit(f"{i}:"), *[F.substring("phash", a, n) for a, n in spans]) for i, spans in enumerate(chosen)]
    cut = hashes.select("phash", "bits", F.explode(F.array(*keys)).alias("k"))
    keyed = lambda x: cut.select("k", F.col("phash").alias(x), F.col("bits").alias(f"bits_{x}"))
    pairs = keyed("a").join(keyed("b"), "k").where("a < b").select("a", "b", apart("a", "b").alias("distance"))
    return pairs.where(F.col("distance") <= threshold).distinct()


def near_pairs(images: DataFrame, threshold: int) -> DataFrame:
    """(a_ord, a_pos, a_submission, b_ord, b_pos, b_submission, distance) of images with different hashes within the threshold, a before b.

    A pair of hashes comes once, and the images that hold them are put in order when they have met: half the rows of hashes that meet from both sides. Images without a submission
    give pairs without it. Pairs of crowded hashes grow with the square of the images, so they are neither shuffled nor staged: they come out of blocks of images that meet.
    """
    columns = [c for c in ("ord", "pos", "submission") if c in images.columns]
    hashed = images.where("phash is not null").select("phash", *columns)
    size = hashed.agg(F.count("*").alias("images"), F.count_distinct("phash").alias("hashes")).first()
    if threshold <= 15 and neighbours(size["hashes"], threshold) >= CROWDED:
        met = met_in_blocks(hashed, columns, size["images"], threshold)
    else:
        side = lambda x, hash_: hashed.select(F.col("phash").alias(hash_), *[F.col(c).alias(f"{x}_{c}") for c in columns])
        met = near_hashes(images, threshold).join(side("x", "a"), "a").join(side("y", "b"), "b")
    x, y = (F.struct(f"{n}_ord", f"{n}_pos") for n in "xy")
    first = lambda c, one, other: F.when(x < y, F.col(f"{one}_{c}")).otherwise(F.col(f"{other}_{c}"))
    return met.where(x != y).select(*[first(c, "x", "y").alias(f"a_{c}") for c in columns], *[first(c, "y", "x").alias(f"b_{c}") for c in columns], "distance")


# --- blocks of images ---

#: Images of a block, blocks that one task meets with as many others at most, comparisons that one step makes, pairs of images that leave Python at once.
BLOCK, BLOCKS, STEP, BATCH = 10_000, 8, 1 << 18, 1 << 17


def met_in_blocks(hashed: DataFrame, columns: list[str], n: int, threshold: int) -> DataFrame:
    """(x_<column>, y_<column>, distance) of all pairs of n images whose hashes differ and are within the threshold, each from one side.

    Images in the order of their hashes are cut into blocks, a hash that many share into several, and blocks of hashes of one length meet in a Cartesian product, whose tasks read some blocks
    of both sides: what is shuffled and staged grows with the images, what a task holds does not. Of two blocks either one is x, by turns.
    """
    placed = numbered(hashed, [F.length("phash"), "phash"], "at")
    cut = placed.groupBy(F.floor(F.col("at") / BLOCK).alias("block"), F.length("phash").alias("length")).agg(F.collect_list(F.struct("phash", *columns)).alias("images"))
    count = -(-n // BLOCK)
    dealt = stage(cut, "blocks", group_rows=BLOCKS).repartitionByRange(-(-count // min(BLOCKS, max(1, count // 8))), "block")
    side = lambda x: dealt.select(*[F.col(c).alias(f"{x}_{c}") for c in dealt.columns])
    even = (F.col("x_block") + F.col("y_block")) % 2 == 0
    turn = (F.col("x_block") == F.col("y_block")) | F.when(even, F.col("x_block") < F.col("y_block")).otherwise(F.col("x_block") > F.col("y_block"))
    pairs = side("x").join(side("y").hint("shuffle_replicate_nl"), (F.col("x_length") == F.col("y_length")) & turn)
    met = pairs.select((F.col("x_block") == F.col("y_block")).alias("same"), "x_images", "y_images")
    fields = [f"{x}_{c} {hashed.schema[c].dataType.simpleString()}" for x in "xy" for c in columns]
    return met.mapInArrow(lambda batches: meetings(batches, columns, threshold), ", ".join([*fields, "distance int"]))


class Block:
    """The different hashes of a block as rows of characters, and its images in the order of their hashes."""

    def __init__(self, images: pa.StructArray, columns: list[str]) -> None:
        hashes = images.field("phash").dictionary_encode()
        at = hashes.indices.to_numpy()
        order = pa.array(np.argsort(at, kind="stable"))
        self.columns = [images.field(c).take(order) for c in columns]
        self.count = np.bincount(at, minlength=len(hashes.dictionary))
        self.start = np.cumsum(self.count) - self.count
        self.codes = np.frombuffer("".join(hashes.dictionary.to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(self.count), -1)
        if self.codes.size and self.codes.max() < 256:
            self.codes = self.codes.astype(np.uint8)


def close_hashes(x: Block, y: Block, same: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the hashes of two blocks that differ and are within the threshold; within one block, i < j. A bounded number of comparisons at a time."""
    length, n = x.codes.shape[1], len(y.count)
    across = np.ascontiguousarray(y.codes.T)
    kind = np.uint8 if length < 256 else np.int64
    rows = max(1, STEP // n)
    for start in range(0, len(x.count), rows):
        some = x.codes[start : start + rows]
        equal, one = np.zeros((len(some), n), kind), np.empty((len(some), n), bool)
        for k in range(length):
            np.equal(some[:, k, None], across[k], out=one)
            equal += one
        i, j = np.nonzero((equal >= max(0, length - threshold)) & (equal < length))
        apart = length - equal[i, j].astype(np.int32)
        i += start
        ahead = i < j if same else slice(None)
        yield i[ahead], j[ahead], apart[ahead]


def meetings(batches: Iterator[pa.RecordBatch], columns: list[str], threshold: int) -> Iterator[pa.RecordBatch]:
    """The pairs of images of blocks that meet."""
    names = [*[f"{x}_{c}" for x in "xy" for c in columns], "distance"]
    for batch in batches:
        for same, *images in zip(*batch.columns, strict=True):
            x, y = (Block(one.values, columns) for one in images)
            for i, j, apart in close_hashes(x, y, same.as_py(), threshold):
                pairs = x.count[i] * y.count[j]
                ends = np.cumsum(pairs)
                for start in range(0, int(ends[-1]) if len(ends) else 0, BATCH):
                    stop = min(start + BATCH, int(ends[-1]))
                    low, high = np.searchsorted(ends, [start, stop - 1], "right") + [0, 1]
                    spread = np.minimum(ends[low:high], stop) - np.maximum(ends[low:high] - pairs[low:high], start)
                    of = np.repeat(np.arange(low, high), spread)
                    u, v = np.divmod(np.arange(start, stop) - (ends - pairs)[of], y.count[j[of]])
                    at_x, at_y = pa.array(x.start[i[of]] + u), pa.array(y.start[j[of]] + v)
                    yield pa.RecordBatch.from_arrays([*[c.take(at_x) for c in x.columns], *[c.take(at_y) for c in y.columns], pa.array(apart[of])], names)


def tied(images: DataFrame, close: DataFrame | None) -> DataFrame:
    """The images that share bytes, hash and directory, or a near hash with another one, or are known from before: only they can be duplicates.

    Without `close` every hash counts as near to another one. Each carries its place `at` (ord, pos) and `who`, what a message tells of it.
    """
    rows = images.where("sha256 is not null").withColumn("at", F.struct("ord", "pos")).withColumn("who", F.struct("submission", "path"))
    repeated = images.where("sha256 is not null").groupBy("sha256").count().where("count > 1").select("sha256")
    known = F.col("known_exact").isNotNull() | F.col("known_near").isNotNull()
    columns = ["submission", "ord", "pos", "key", "sha256", "phash", "at", "who", "known_exact", "known_near"]
    if close is None:
        return rows.join(repeated.withColumn("t1", F.lit(True)), "sha256", "left").where(F.col("t1") | F.col("phash").isNotNull() | known).select(*columns)
    same = images.where("sha256 is not null and phash is not null").groupBy("key", "phash").count().where("count > 1").select("key", "phash")
    near = close.select(F.col("a").alias("phash")).union(close.select("b")).distinct()
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    marked = rows.join(mark(repeated, "t1"), "sha256", "left").join(mark(same, "t2"), ["key", "phash"], "left").join(mark(near, "t3"), "phash", "left")
    return marked.where(F.col("t1") | F.col("t2") | F.col("t3") | known).select(*columns)


def before(state: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, seen, may): the earliest remembered image of each group, and the earliest that may still be."""
    some = state.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    groups = some.groupBy(*by).agg(F.min(F.when(F.col("kept"), F.struct("at", "who"))).alias(f"{name}_seen"), F.min(F.when(F.col("kept").isNull(), F.col("at"))).alias(f"{name}_may"))
    return groups


def nearest(groups: DataFrame, edges: DataFrame, by: list[str], name: str) -> DataFrame:
    """groups of before(by phash) seen from each hash of edges (phash, other, distance): what is near to it."""
    seen = F.when(F.col(f"{name}_seen").isNotNull(), F.struct(F.col(f"{name}_seen.at").alias("at"), F.col(f"{name}_seen.who").alias("who"), "distance"))
    joined = edges.join(groups.withColumnRenamed("phash", "other"), "other")
    return joined.groupBy(*by).agg(F.min(seen).alias(f"{name}_seen"), F.min(f"{name}_may").alias(f"{name}_may"))


# --- components ---

#: Edges that one task joins; more are contracted in rounds before.
LOCAL_EDGES = 1 << 20
#: Photos of a component that one task scans; a larger component is settled in rounds.
FOLD_ROWS = 20_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[label]


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, label) of the nodes of edges (a, b), which are random numbers: nodes of one component have one label.

    At most `local` edges are joined by one task. While there are more, each node is contracted with its least neighbour, which a fraction of the nodes survives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        node, label = joined(table.column("a").to_numpy(), table.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    labels = None
    edges = stage(edges.where("a != b").distinct(), "edges")
    while edges.count() > local:
        both = edges.unionAll(edges.select("b", "a"))
        to = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "contracted")
        of = lambda end: to.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}"))  # noqa: B023, E731
        less = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        labels = to if labels is None else stage(labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        edges = stage(less.where("a != b").distinct(), "edges")
    last = edges.coalesce(1).mapInArrow(run, "node long, label long")
    if labels is None:
        return last
    return labels.join(last.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def in_components(rows: DataFrame, close: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """rows of tied() with their component `part` and its number of rows `size`; staged."""
    node = lambda kind, *c: F.xxhash64(F.lit(kind), *c)
    own = node("submission", "ord", "submission")
    edges = rows.select(own.alias("a"), node("content", "sha256").alias("b")).unionAll(rows.where("phash is not null").select(own, node("hash", "phash"))).unionAll(close.select(node("hash", "a"), node("hash", "b")))
    labels = components(edges, local)
    placed = rows.withColumn("node", own).join(labels, "node").withColumnRenamed("label", "part").drop("node")
    placed = stage(placed, "placed")
    return placed.join(placed.groupBy("part").agg(F.count("*").alias("size")), "part")


# --- the scan of one component ---


class Hashes:
    """Remembered hashes in order, with what is told of each; only hashes of one length are compared."""

    def __init__(self) -> None:
        self.by_length: dict[int, tuple[np.ndarray, list]] = {}

    @staticmethod
    def code(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def add(self, text: str, told) -> None:
        codes, all_told = self.by_length.get(len(text)) or (np.zeros((4, len(text)), np.uint32), [])
        if len(all_told) == len(codes):
            codes = np.concatenate([codes, np.zeros_like(codes)])
        codes[len(all_told)] = self.code(text)
        all_told.append(told)
        self.by_length[len(text)] = codes, all_told

    def first(self, text: str, least: int, most: int):
        """(told, distance) of the first hash whose distance is in the range."""
        codes, told = self.by_length.get(len(text)) or (None, [])
        if not told:
            return None
        apart = (codes[: len(told)] != self.code(text)).sum(axis=1)
        near = (apart >= least) & (apart <= most)
        at = int(near.argmax())
        return (told[at], int(apart[at])) if near[at] else None


def identical(submission) -> str:
    return f"Image identical to submission {submission} (SHA256 match)"


def in_folder(path: str, distance: int) -> str:
    return f"Image similar to file in directory (pHash match (similarity score: {distance:.1f})): {path}"


class Scan:
    """The sequential scan of one component."""

    def __init__(self, threshold: int) -> None:
        self.threshold, self.seen, self.hashes, self.folders = threshold, {}, Hashes(), {}
        self.ord, self.flagged = None, False

    def step(self, ord_, submission, key, sha256: str, phash: str | None, path: str, exact: str | None, near) -> list[str]:
        """What is told of one photo; one without a message is remembered, if its submission has none so far."""
        if ord_ != self.ord:
            self.ord, self.flagged = ord_, False
        if sha256 in self.seen:
            told = [identical(self.seen[sha256])]
        else:
            told, folder = [], self.folders.setdefault(key, Hashes()) if key is not None else Hashes()
            if exact is not None:
                told.append(f"Image identical to file in directory (SHA256 match): {exact}")
            else:
                found = near or (folder.first(phash, 0, self.threshold) if phash is not None else None)
                told += [in_folder(*found)] if found else []
            other = self.hashes.first(phash, 1, self.threshold) if phash is not None else None
            told += [f"Image similar to submission {other[0]} (pHash distance: {other[1]}, threshold: {self.threshold})"] if other else []
        self.flagged = self.flagged or bool(told)
        if not self.flagged:
            self.seen[sha256] = submission
            if phash is not None:
                self.hashes.add(phash, submission)
                folder.add(phash, path)
        return told


TOLD = "pos {pos}, texts array<string>"


def folded(rows: DataFrame, threshold: int) -> DataFrame:
    """(submission, ord, pos, texts) of the duplicates among rows, component by component."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, scan = None, None
        for pdf in batches:
            got = []
            for own, ord_, pos, name, key, sha256, phash, path, exact, near, score in pdf.itertuples(index=False, name=None):
                if scan is None or own != part:
                    part, scan = own, Scan(threshold)
                text = lambda v: v if isinstance(v, str) else None
                told = scan.step(ord_, name, text(key), sha256, text(phash), path, text(exact), (near, int(score)) if text(near) else None)
                if told:
                    got.append((name, ord_, pos, told))
            yield pd.DataFrame(got, columns=["submission", "ord", "pos", "texts"])

    text = lambda c: F.col(c).cast("string").alias(c)
    sent = rows.select("part", "ord", "pos", "submission", text("key"), "sha256", "phash", F.col("who.path").alias("path"), "known_exact", F.col("known_near.path").alias("near"), F.coalesce("known_near.distance", F.lit(0)).alias("score"))
    ordered = sent.repartition("part").sortWithinPartitions("part", "ord", "pos")
    return ordered.mapInPandas(run, f"submission {types['submission']}, ord {types['ord']}, {TOLD.format(pos=types['pos'])}")


def seen_texts(threshold: int) -> Column:
    """What is told of a photo whose earliest remembered neighbours are content_seen, hash_seen and place_seen."""
    content = F.concat(F.lit("Image identical to submission "), F.col("content_seen.who.submission").cast("string"), F.lit(" (SHA256 match)"))
    similar = lambda distance, path: F.concat(F.lit("Image similar to file in directory (pHash match (similarity score: "), F.format_string("%.1f", distance.cast("double")), F.lit(")): "), path)
    place = F.coalesce(
        F.concat(F.lit("Image identical to file in directory (SHA256 match): "), F.col("known_exact")), similar(F.col("known_near.distance"), F.col("known_near.path")),
        similar(F.col("place_seen.distance"), F.col("place_seen.who.path")),
    )
    near = F.concat(
        F.lit("Image similar to submission "), F.col("hash_seen.who.submission").cast("string"), F.lit(" (pHash distance: "), F.col("hash_seen.distance").cast("string"), F.lit(f", threshold: {threshold})")
    )
    return F.when(F.col("content_seen").isNotNull(), F.array(content)).otherwise(F.array_compact(F.array(place, near)))


def unflagged(rows: DataFrame, hit: Column) -> DataFrame:
    """The rows before the first hit of their submission."""
    first = F.min(F.when(hit, F.col("pos"))).over(Window.partitionBy("submission", "ord"))
    return rows.withColumn("first_hit", first).where("first_hit is null or pos < first_hit").drop("first_hit")


def with_seen(rows: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with content_seen, hash_seen and place_seen: the earliest of the remembered photos `kept` that is before each; edges (a, b, distance) lead to hashes of kept ones."""
    to = edges.select(F.col("a").alias("phash"), F.col("b").alias("other"), "distance")
    loops = to.unionAll(kept.where("phash is not null").select("phash", F.col("phash").alias("other"), F.lit(0)).distinct())
    state = kept.withColumn("kept", F.lit(True))
    content, hashed = before(state, ["sha256"], "content"), nearest(before(state, ["phash"], "hash"), to, ["phash"], "hash")
    placed = nearest(before(state, ["key", "phash"], "place"), loops, ["key", "phash"], "place")
    seen = rows.join(content, "sha256", "left").join(hashed, "phash", "left").join(placed, ["key", "phash"], "left")
    return seen.select(*rows.columns, *[F.when(F.col(f"{n}_seen.at") < F.col("at"), F.col(f"{n}_seen")).alias(f"{n}_seen") for n in ("content", "hash", "place")])


def settled_in_blocks(rows: DataFrame, hashes: DataFrame, threshold: int, block_rows: int) -> DataFrame:
    """(submission, ord, pos, texts) of the duplicates among rows, whose hashes are crowded.

    A block is the first `block_rows` photos that may still be remembered (the last submission whole), scanned by one task; its remembered photos settle later ones in parallel.
    """
    known = F.col("known_exact").isNotNull() | F.col("known_near").isNotNull()
    waiting, kept, edges = stage(unflagged(rows, known), "waiting"), [], []
    while (end := waiting.select("ord").orderBy("ord").limit(block_rows).agg(F.max("ord")).first()[0]) is not None:
        block = waiting.where(F.col("ord") <= F.lit(end))
        hits = folded(block.withColumn("part", F.lit(0)), threshold).groupBy("submission", "ord").agg(F.min("pos").alias("first_hit"))
        new = stage(remembered(block, hits), "kept")
        near = stage(near_to(hashes, hashes.join(new.select("phash").distinct(), "phash", "left_semi"), threshold), "near")
        seen = with_seen(waiting.where(F.col("ord") > F.lit(end)), new, near)
        found = F.col("content_seen").isNotNull() | F.col("hash_seen").isNotNull() | F.col("place_seen").isNotNull()
        rest = stage(unflagged(seen, found).select(*rows.columns), "waiting")
        drop(waiting)
        waiting, kept, edges = rest, [*kept, new], [*edges, near]
    if not kept:
        kept, edges = [rows.limit(0)], [hashes.limit(0).select(F.col("phash").alias("a"), F.col("phash").alias("b"), F.lit(0).alias("distance"))]
    seen = with_seen(rows, reduce(DataFrame.unionAll, kept), reduce(DataFrame.unionAll, edges))
    return seen.select("submission", "ord", "pos", seen_texts(threshold).alias("texts")).where(F.size("texts") > 0)


def settled_in_rounds(rows: DataFrame, close: DataFrame, threshold: int) -> DataFrame:
    """(submission, ord, pos, texts) of the duplicates among rows, for components of any size."""
    edges = close.select(F.col("a").alias("phash"), F.col("b").alias("other"), "distance").union(close.select("b", "a", "distance"))
    hashes = rows.where("phash is not null").select("phash").distinct()
    loops = edges.union(hashes.select("phash", F.col("phash").alias("other"), F.lit(0).alias("distance")))
    state = rows.withColumn("hit", F.lit(None).cast("boolean")).withColumn("kept", F.lit(None).cast("boolean"))
    old, done = None, False
    known = F.col("known_exact").isNotNull() | F.col("known_near").isNotNull()
    while True:
        content = before(state, ["sha256"], "content")
        hashed = nearest(before(state, ["phash"], "hash"), edges, ["phash"], "hash")
        placed = nearest(before(state, ["key", "phash"], "place"), loops, ["key", "phash"], "place")
        seen = state.join(content, "sha256", "left").join(hashed, "phash", "left").join(placed, ["key", "phash"], "left")
        earlier: dict[str, Column] = {n: F.coalesce(F.col(f"{n}_seen.at") < F.col("at"), F.lit(False)) for n in ("content", "hash", "place")}
        found = known | earlier["content"] | earlier["hash"] | earlier["place"]
        open_ = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{n}_may") < F.col("at"), F.lit(False)) for n in earlier])
        hit = F.coalesce("hit", F.when(found, True).when(~open_, False))
        keep = [F.when(earlier[n], F.col(f"{n}_seen")).alias(f"{n}_seen") for n in earlier]
        settled = seen.select(*rows.columns, hit.alias("hit"), *keep)
        # A photo is remembered if no photo of its submission up to it is a duplicate.
        own = settled.groupBy("submission", "ord").agg(F.min(F.when(F.col("hit"), F.col("pos"))).alias("first_hit"), F.min(F.when(F.col("hit").isNull(), F.col("pos"))).alias("first_open"))
        kept = F.when(F.coalesce(F.col("pos") >= F.col("first_hit"), F.lit(False)), False).when(F.coalesce(F.col("pos") >= F.col("first_open"), F.lit(False)), None).otherwise(True)
        now = settled.join(own, ["submission", "ord"]).withColumn("kept", kept.cast("boolean")).drop("first_hit", "first_open")
        now = stage(now, "settled")
        if old is not None:
            drop(old)
        if done:  # the last round names the first holders, with all photos settled
            break
        done = now.where("hit is null").isEmpty()
        old, state = now, now.drop("content_seen", "hash_seen", "place_seen")
    return now.where("hit").select("submission", "ord", "pos", seen_texts(threshold).alias("texts"))


KNOWN = "struct<path:string,distance:int>"


def greedy_messages(images: DataFrame, threshold: int, *, fold_rows: int = FOLD_ROWS, local_edges: int = LOCAL_EDGES, crowd: float = CROWDED) -> DataFrame:
    """(submission, ord, first_hit, messages) of the submissions with duplicates: the place of the first, and what each of their photos repeats, in order of the scan."""
    absent = {"known_exact": F.lit(None).cast("string"), "known_near": F.lit(None).cast(KNOWN)}
    images = images.withColumns({k: v for k, v in absent.items() if k not in images.columns})
    hashes = distinct_hashes(images)
    if neighbours(hashes.count(), threshold) >= crowd:
        told = settled_in_blocks(stage(tied(images, None), "tied"), hashes, threshold, fold_rows)
    else:
        close = stage(near_among(hashes, threshold, crowd), "close")
        rows = stage(in_components(stage(tied(images, close), "tied"), close, local_edges), "components")
        told = folded(rows.where(F.col("size") <= fold_rows), threshold)
        large = rows.where(F.col("size") > fold_rows).drop("part", "size")
        if not large.isEmpty():
            told = told.unionByName(settled_in_rounds(large, close, threshold))
    return told.groupBy("submission", "ord").agg(F.min("pos").alias("first_hit"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "texts"))), lambda x: x["texts"])).alias("messages"))


def remembered(images: DataFrame, found: DataFrame) -> DataFrame:
    """The images that the scan remembers: those before the first duplicate of their submission. found: of greedy_messages()."""
    first = found.select("submission", "ord", "first_hit")
    return images.where("sha256 is not null").join(first, ["submission", "ord"], "left").where(F.col("first_hit").isNull() | (F.col("pos") < F.col("first_hit"))).drop("first_hit")


def greedy(images: DataFrame, threshold: int) -> DataFrame:
    """(submission, ord, flagged) of every submission with images, by the sequential scan."""
    found = greedy_messages(images, threshold).select("submission", "ord", F.lit(True).alias("flagged"))
    return images.select("submission", "ord").distinct().join(found, ["submission", "ord"], "left").select("submission", "ord", F.coalesce("flagged", F.lit(False)).alias("flagged"))


def against_target(images: DataFrame, sha256: str | Column, phash: str | Column, threshold: int) -> DataFrame:
    """One target against all: 'exact', 'similar' or null."""
    d = hamming(F.col("phash"), F.lit(phash))
    return images.withColumn("match", F.when(F.col("sha256") == sha256, "exact").when(d <= threshold, "similar"))


def first_images(images: DataFrame) -> DataFrame:
    return images.groupBy("submission").agg(F.min_by("sha256", F.struct("ord", "pos")).alias("sha256"))
