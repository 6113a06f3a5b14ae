"""Sharding along a Hilbert curve for multidimensional file pruning.

Metadata dimensions are quantised to `bits` bits each: text values by their rank among the distinct values,
sizes by their logarithm. Rows are sorted by the curve index of their cell and cut into runs, so each
shard covers a compact box of all dimensions at once. The law is `rows`: shard sizes differ by one at most.

Within a cell rows are ordered by lang, source, text checksum and doc_id, so equal texts of one lang and
source are neighbours. A group of any size is cut where the run ends; it never lands in one task.

Defined results: a null text has size 1 and checksum 0; null lang, source or doc_id sort first; equal rows
are placed in any order among themselves; an empty table gives no rows, fewer rows than shards leave the
others empty; extra columns are ignored unless carried, then under their own or a longer name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import stage, table
from rubrica.llm.order import ranked

SHARDS, BITS = 8, 5
TAKEN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def rotate_left(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(next state, digit) at state * 2**n + corner, for the n-dimensional Hilbert curve.

    A state is entry * n + direction. The tables follow from the Gray code: the sub-cube of rank w is
    entered at corner gray(2 * floor((w - 1) / 2)) and crossed along the trailing ones of w.
    """
    gray = lambda i: i ^ (i >> 1)
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    rank = {gray(w): w for w in range(1 << n)}
    after, digit = [], []
    for state in range((1 << n) * n):
        entry, axis = divmod(state, n)
        for corner in range(1 << n):
            w = rank[rotate_left(corner ^ entry, n - (axis + 1) % n, n)]
            begin = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            along = 0 if w == 0 else trailing(w - 1) % n if w % 2 == 0 else trailing(w) % n
            after.append((entry ^ rotate_left(begin, axis + 1, n)) * n + (axis + along + 1) % n)
            digit.append(w)
    return after, digit


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell given by its coordinates, each below 2**bits."""
    n = len(cells)
    after, digit = (F.array(*map(F.lit, t)) for t in curve_tables(n))

    def step(acc, bit):
        corner = sum(((F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1))) * (1 << j) for j, c in enumerate(cells)), F.lit(0))
        at = acc["state"] * (1 << n) + corner + 1
        return F.struct(F.element_at(after, at).alias("state"), (acc["h"] * (1 << n) + F.element_at(digit, at)).alias("h"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)]), start, step)["h"]


def quantised(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, cell) of the distinct values: their rank, scaled to 2**bits cells. Null is the least value."""
    values = stage(df.select(F.col(column).alias("value")).distinct(), "values")
    n = max(1, values.count())
    return ranked(values, ["value"]).select("value", F.expr(f"cast(rank * {1 << bits} div {n} as int)").alias("cell"))


def assign(docs: DataFrame, n_shards: int = SHARDS, carry: list[str] = (), bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) and the carried columns; one that has such a name gets underscores behind it."""
    text = F.coalesce("text", F.lit(""))
    carry = [c for c in carry if c.lower() != "doc_id"]
    carried = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(carry)]
    slim = stage(docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *carried), "slim")
    for column in ("lang", "source"):
        cells = quantised(slim, column, bits).select(F.col("value").alias("v"), F.col("cell").alias(f"x_{column}"))
        slim = slim.join(cells, slim[column].eqNullSafe(F.col("v")), "left").drop("v")
    amount = F.least(F.floor(F.log2("size")), F.lit((1 << bits) - 1)).cast("int")
    curved = slim.withColumn("h", curve_index([F.col("x_lang"), F.col("x_source"), amount], bits))  # computed twice; a table of it would hold all that is carried once more
    n = slim.count()
    placed = ranked(curved, ["h", "lang", "source", "text_crc32", "doc_id"])
    cut = placed.withColumn("shard", F.expr(f"cast(rank * {n_shards} div {max(1, n)} as int)"))
    slot = F.expr(f"rank - (shard * {n}L + {n_shards - 1}) div {n_shards}")
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("curve"), *[F.col(f"c_{i}").alias(n) for i, n in enumerate(kept_names(carry))])


def kept_names(carry: list[str]) -> list[str]:
    """The carried columns' names, with as many underscores behind them as it takes to be no column of the result."""
    taken, out = {"doc_id", *TAKEN}, []
    others = [c.lower() for c in carry]
    for c in carry:
        name = c
        while name.lower() in taken or name != c and name.lower() in others:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Write the documents as one folder per shard, in curve order."""
    keep = [c for c in docs.columns if c not in ("doc_id", *TAKEN)]
    out = assign(docs, n_shards, keep)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("doc_id", *keep, "shard").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).drop("curve")
