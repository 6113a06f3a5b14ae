"""Substring deduplication by sliding sentence spans.

A text is cut into units: sentences (ended by . ! ? and white space, or by a line break), those of WINDOW words or
more also cut at content-defined places: after the word of least hash in every window of WINDOW words. White space is
that of ASCII. A run is the fewest consecutive units that are RUN at least, hold MIN_CHARS characters and LEAST words,
where a unit counts as SENTENCE words at least (so three sentences suffice, pieces of sentences need LEAST words);
it is taken from each unit on and up to each unit, so every stretch of units that is long enough is covered. Runs are
hashed by their words and compared over all documents; every unit covered by a run that occurred before (by doc_id,
then row, then position) is removed.

Cuts inside a passage depend on its own words from its first to its last whole window, so a passage of 50 words has
more than RUN whole units in common with its copy, wherever it stands: its ends lose at most WINDOW words each.

Counting is combined before the shuffle, so a passage in a third of all rows costs one row a task; marks go
back by a join that Spark may split.

Defined results: null stays null, texts too short for a run are left alone, and so are all texts if nothing
repeats; repeated rows lose all repeated runs but in the first row; null ids come first; an empty table gives no
rows; extra columns are ignored by remove_repeats(); texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import Words, byte_table, flat_text, mix, slices, space_bytes, stage, table

RUN, MIN_CHARS, WINDOW, LEAST, SENTENCE = 3, 40, 10, 20, 7
SPAN_BITS = 6  # a run has MIN_CHARS units at most


def minima(hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """True at the word of least hash (the last of equal ones) of each window that lies in one sentence."""
    out, n = np.zeros(len(hashes), bool), len(hashes) - WINDOW + 1
    if n > 0:
        least, at = hashes[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, WINDOW):
            here = hashes[j : n + j]
            less = here <= least
            least[less] = here[less]
            at[less] = j
        whole = sentence[:n] == sentence[WINDOW - 1 :]
        out[(at + np.arange(n))[whole]] = True
    return out


class Units:
    """Units and runs of the rows of a slice."""

    def __init__(self) -> None:
        values = byte_table(space_bytes(), 5)
        values[65:91] = np.random.default_rng(6).integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words = Words(values)
        self.ends = np.isin(np.arange(256), list(b".!?"))

    def __call__(self, column: pa.Array) -> None:
        self.data, offsets = flat_text(column)
        self.hashes, starts, ends, first, counts = self.words.hashes(self.data, offsets)
        n = len(starts)
        lines = np.cumsum(self.data == 10)
        stop = self.ends[self.data[ends - 1]]
        if n > 1:
            stop[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
        stop[(first + counts - 1)[counts > 0]] = True
        sentence = np.cumsum(stop) - stop
        self.last = np.flatnonzero(stop | minima(self.hashes, sentence))  # last word of each unit
        self.first = np.append(0, self.last[:-1] + 1)[: len(self.last)]
        self.starts, self.ends_at = starts[self.first], ends[self.last]
        self.row_first = np.searchsorted(self.first, first)
        self.row_counts = np.diff(np.append(self.row_first, len(self.first)))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first unit in the row and number of units) of every run."""
        n = len(self.first)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(self.row_counts)), self.row_counts)
        low, high = self.row_first[row], (self.row_first + self.row_counts)[row]
        chars = np.append(0, np.cumsum(self.ends_at - self.starts))
        words = np.append(0, np.cumsum(np.maximum(self.last - self.first + 1, SENTENCE)))
        unit = np.arange(n)
        end = np.maximum(np.maximum(np.searchsorted(chars, chars[:-1] + MIN_CHARS), np.searchsorted(words, words[:-1] + LEAST)), unit + RUN)
        begin = np.minimum(np.minimum(np.searchsorted(chars, chars[1:] - MIN_CHARS, "right"), np.searchsorted(words, words[1:] - LEAST, "right")) - 1, unit + 1 - RUN)
        on, back = end <= high, begin >= low
        back[back] &= end[begin[back]] != unit[back] + 1  # that run is taken from its first unit on
        a, b = np.concatenate([unit[on], begin[back]]), np.concatenate([end[on], unit[back] + 1])
        sums = np.append(np.uint64(0), np.cumsum(mix(self.hashes) * self.words.powers[: len(self.hashes)]))
        from_, to = self.first[a], self.last[b - 1] + 1
        h = mix((sums[to] - sums[from_]) * self.words.inverses[from_] + (to - from_).astype(np.uint64))
        return h.view(np.int64), row[a], (a - low[a]) << SPAN_BITS | (b - a)

    def without(self, r: int, runs: list[int]) -> tuple[str, int]:
        """The text of a row without the units of these runs; the number of units removed."""
        base, n = int(self.row_first[r]), int(self.row_counts[r])
        gone = np.zeros(n, bool)
        for x in runs:
            gone[x >> SPAN_BITS : (x >> SPAN_BITS) + (x & (1 << SPAN_BITS) - 1)] = True
        kept = np.flatnonzero(~gone).tolist()
        starts, ends, data, out = self.starts, self.ends_at, self.data, []
        for i, j in zip(kept, [*kept[1:], None][: len(kept)], strict=True):
            a, b = starts[base + i], ends[base + i]
            gap = b"" if j is None else bytes(data[b : starts[base + j]])
            out.append(bytes(data[a:b]) + (gap if j is None or j == i + 1 else b"\n" if b"\n" in gap else b" "))
        return b"".join(out).decode(), int(gone.sum())


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with uid, which tells rows apart: doc_id where it does so, else a staged row number."""
    docs = docs.select("doc_id", "text")
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int"):
        most = docs.groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
        if most[0] in (None, 1) and not most[1]:
            return docs.withColumn("uid", F.col("doc_id").cast("long"))
    return stage(docs.withColumn("uid", F.monotonically_increasing_id()), "rows")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_units, n_removed) of every document."""
    id_type = dict(docs.dtypes)["doc_id"]
    rows = with_row_key(docs)

    def emit(batches):
        units = Units()
        for whole in batches:
            for batch in slices(whole, "text"):
                units(batch.column("text"))
                h, row, at = units.runs()
                for i in range(0, len(h), 500_000):
                    take = pa.array(row[i : i + 500_000])
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 500_000]), batch.column("doc_id").take(take), batch.column("uid").take(take), pa.array(at[i : i + 500_000])], ["h", "doc_id", "uid", "at"])

    runs = rows.mapInArrow(emit, f"h long, doc_id {id_type}, uid long, at long")
    least = F.min(F.struct("doc_id", "uid", "at"))
    repeated = runs.groupBy("h").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1").select("h", F.col("first.uid").alias("first_uid"), F.col("first.at").alias("first_at"))
    repeated = stage(repeated, "repeated")
    marks = runs.select("h", "uid", "at").join(repeated, "h").where("uid != first_uid or at != first_at")
    marks = stage(marks.groupBy("uid").agg(F.collect_list("at").alias("starts")), "marks")

    def remove(batches):
        units = Units()
        for whole in batches:
            for batch in slices(whole, "text"):
                units(batch.column("text"))
                texts, removed = batch.column("text").to_pylist(), [0] * batch.num_rows
                for i, runs in enumerate(batch.column("starts").to_pylist()):
                    if runs:
                        texts[i], removed[i] = units.without(i, runs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(units.row_counts.astype(np.int64)), pa.array(removed, pa.int64())], ["doc_id", "text", "n_units", "n_removed"])

    return rows.join(marks, "uid", "left").select("doc_id", "text", "starts").mapInArrow(remove, f"doc_id {id_type}, text string, n_units long, n_removed long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
