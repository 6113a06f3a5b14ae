"""Shared building blocks: staging, Arrow text access, byte-level tokenising and tree sums.

Text is handled as one flat UTF-8 buffer per Arrow slice, so tokenising and hashing are numpy
operations over whole slices instead of per-document loops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.plans.staging import drop, shared_dir, stage

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def crc_mod(column: str, m: int):
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % m


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most `limit` bytes of the text column, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one buffer and the offsets of its rows; null is an empty text."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_table(is_word: np.ndarray, seed: int) -> np.ndarray:
    """A random 64-bit value for each word byte (A-Z as a-z), 0 for separators."""
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return np.where(is_word, values, np.uint64(0))


def alnum_bytes() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z is lower-cased: 0-9, letters, non-ASCII."""
    b = np.arange(256)
    return (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90))


def space_bytes() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    b = np.arange(256)
    return ~((b == 32) | ((b >= 9) & (b <= 13)))


ROOT = np.uint64(0x9E3779B97F4A7C15)
ROOT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Word spans and hashes of a flat text buffer.

    A word's hash is a polynomial over random byte values, taken from prefix sums modulo 2**64; equal
    words have equal hashes everywhere. counts holds the words of each row, first the index of its
    first word.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            step = np.full(n, ROOT, np.uint64)
            step[0] = 1
            self.powers = np.cumprod(step)
            step = np.full(n, ROOT_INVERSE, np.uint64)
            step[0] = 1
            self.inverses = np.cumprod(step)

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        coded = self.values[data]
        word = coded != 0
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (cut[:-1] | ~before))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (cut[1:] | ~after)) + 1
        first = np.searchsorted(starts, offsets[:-1])
        counts = np.diff(np.append(first, len(starts)))
        return coded, starts, ends, first, counts

    def hashes(self, data: np.ndarray, offsets: np.ndarray):
        coded, starts, ends, first, counts = self.spans(data, offsets)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(coded * self.powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts]), starts, ends, first, counts


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words, by its first word; the last k - 1 places are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * ROOT + hashes[j : n + j]
    return mix(out)


def whole_grams(counts: np.ndarray, k: int) -> np.ndarray:
    """True at each place of grams() whose run stays inside one row."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return left[: max(0, total - k + 1)] >= k


VECTOR_SCHEMA = "part long, chunk int, vec binary"


def vector_rows(part: int, vector: np.ndarray, chunk: int = 1 << 15) -> pa.RecordBatch:
    """A task's dense sums as rows of VECTOR_SCHEMA."""
    pieces = [vector[i : i + chunk].tobytes() for i in range(0, len(vector), chunk)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())],
        ["part", "chunk", "vec"],
    )


def sum_vectors(df: DataFrame, parts: int, length: int, dtype: str, fan: int = 64, total: str | None = None) -> np.ndarray:
    """Sum the dense vectors of all tasks in a tree: no step gathers more than `fan` pieces of one chunk.

    The result has `length` entries of type `total`, a parameter of the caller that does not grow with the data. Pieces are added in order
    of their parts, so sums of floats do not depend on the order of their arrival.
    """
    kind, wide = dtype, total or dtype

    def folder(kind: str):
        def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            out = sum(np.frombuffer(v, kind).astype(wide) for v in pdf.sort_values("origin")["vec"])
            return pd.DataFrame({"part": [key[1]], "chunk": [key[0]], "vec": [np.asarray(out, wide).tobytes()]})

        return fold

    while True:
        parts = -(-parts // fan)
        keyed = df.select(F.col("part").alias("origin"), "chunk", "vec", F.expr(f"part % {parts}").alias("part"))
        df, kind = keyed.groupBy("chunk", "part").applyInPandas(folder(kind), VECTOR_SCHEMA), wide
        if parts == 1:
            break
    got = sorted((r["chunk"], r["vec"]) for r in df.select("chunk", "vec").collect())
    return np.concatenate([np.frombuffer(v, wide) for _, v in got]) if got else np.zeros(length, wide)


def task_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()

