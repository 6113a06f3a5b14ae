"""Benchmark decontamination by winnowing.

Test items and documents are reduced to winnowed fingerprints: the minimum k-gram hash of each window of
`window - k + 1` k-grams, so any shared run of `window` words shares a fingerprint. Documents that hit one
are extended: all their `window`-word runs are compared with the items' runs, first by hash and then word
for word, so the result is exact. Items of fewer than `window` words are one run of their own length.

Defined results: a null or wordless text has no words and no hits; items with a null id or no words are
skipped; repeated item ids count once; repeated documents give a row each; an empty table gives no rows,
an empty benchmark no hits. Extra columns are ignored. A text of any length is taken whole.

A benchmark of at most `block_chars` characters is broadcast as one block, and one pass over the documents answers.
A larger one never meets in one place: distinct fingerprints of documents and items are joined, and the runs of
the documents that share one are joined with the items' runs. That reads the documents three times.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import Words, alnum_bytes, byte_table, flat_text, fresh, grams, slices, stage, whole_grams

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
K = 5


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out = x[: len(x) - w + 1].copy()
    for j in range(1, w):
        np.minimum(out, x[j : len(out) + j], out=out)
    return out


def winnow(words: np.ndarray, counts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimum k-gram hash of every whole window of words, and which windows stay in one row."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return sliding_min(grams(words, k), window - k + 1), whole_grams(counts, window)


def build_index(items: list[tuple], window: int, k: int, values: np.ndarray) -> dict:
    """Fingerprints, and the runs of every length as {joined words: item ids}."""
    runs: dict[int, dict[str, set]] = {}
    prints = []
    hasher = Words(values)
    for item, text in items:
        words = words_of(text)
        if item is None or not words:
            continue
        n = min(window, len(words))
        for i in range(len(words) - n + 1):
            runs.setdefault(n, {}).setdefault(" ".join(words[i : i + n]), set()).add(item)
        if n == window:
            data, offsets = flat_text(pa.array([" ".join(words)]))
            hashes, _, _, _, counts = hasher.hashes(data, offsets)
            low, whole = winnow(hashes, counts, window, k)
            prints.append(low[whole])
    hashes = {}
    for n, table in runs.items():
        data, offsets = flat_text(pa.array(list(table)))
        h, _, _, _, counts = hasher.hashes(data, offsets)
        hashes[n] = np.unique(grams(h, n)[whole_grams(counts, n)])
    return {"window": window, "k": k, "runs": runs, "hashes": hashes, "prints": np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)}


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of x whose value is in the sorted table; a bitmap of low bits goes first."""
    if not len(x) or not len(table):
        return np.zeros(0, np.int64)
    bits = max(16, int(len(table)).bit_length() + 4)
    mask = np.uint64((1 << bits) - 1)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[table & mask] = True
    near = np.flatnonzero(bitmap[x & mask])
    at = np.searchsorted(table, x[near])
    at[at == len(table)] = 0
    return near[table[at] == x[near]]


def hits_of(column: pa.Array, index: dict, hasher: Words) -> tuple[np.ndarray, dict[int, tuple[list, list]]]:
    """Word counts of all rows; for rows with hits, their covered word ranges and item ids."""
    data, offsets = flat_text(column)
    words, _, _, first, counts = hasher.hashes(data, offsets)
    window = index["window"]
    suspects: set[int] = set()
    owner = lambda places: np.searchsorted(np.cumsum(counts), places, "right")
    if len(index["prints"]):
        low, whole = winnow(words, counts, window, index["k"])
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | ~whole[:-1]
        places = np.flatnonzero(new & whole)
        suspects.update(owner(places[member(low[places], index["prints"])]).tolist())
    for n in index["hashes"]:
        if n < window:
            g = grams(words, n)
            places = np.flatnonzero(whole_grams(counts, n))
            suspects.update(owner(places[member(g[places], index["hashes"][n])]).tolist())
    found = {}
    for row in sorted(suspects):
        own = words[first[row] : first[row] + counts[row]]
        text, ranges, ids = None, [], set()
        for n, table in index["hashes"].items():
            for i in member(grams(own, n), table).tolist():
                text = text or words_of(column[row].as_py())
                items = index["runs"][n].get(" ".join(text[i : i + n]))
                if items:
                    ranges.append((i, i + n))
                    ids |= items
        if ranges:
            found[row] = (merged(ranges), sorted(ids))
    return counts, found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


SCHEMA = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<a:long,b:long>>, items array<{item}>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = K, block_chars: int = 2_000_000, keep_text: bool = False) -> DataFrame:
    """One row per document with its hit words, hit spans and the items that occur in it.

    keep_text adds the columns of docs, for filters that follow.
    """
    bench = benchmark.select(F.col("item_id"), F.col("text"))
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    item_type = dict(bench.dtypes)["item_id"]
    id_type = dict(docs.dtypes)["doc_id"]
    values = byte_table(alnum_bytes(), 7)
    sc = docs.sparkSession.sparkContext
    extra = docs.columns if keep_text else ["doc_id"]
    out = SCHEMA.format(id=id_type, item=item_type)
    if keep_text:
        taken = {"doc_id", *(f.split()[0] for f in out.split(", ")[1:])}
        extra = ["doc_id", *(c for c in docs.columns if c not in taken)]
        out += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in extra[1:])
    fits = chars <= block_chars
    block = sc.broadcast(build_index([tuple(r) for r in bench.collect()] if fits else [], window, k, values))

    def run(batches):
        hasher, index = Words(values), block.value
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, found = hits_of(batch.column("text"), index, hasher)
                spans = [found.get(i, ((), ()))[0] for i in range(len(counts))]
                items = [found.get(i, ((), ()))[1] for i in range(len(counts))]
                n_hit = [sum(b - a for a, b in s) for s in spans]
                columns = [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([digest(x) for x in items]), pa.array([n > 0 for n in n_hit]),
                    pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([list(x) for x in items], pa.list_(ARROW.get(item_type, pa.string()))),
                ]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
                yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in extra if keep_text and c != "doc_id"], names + [c for c in extra if keep_text and c != "doc_id"])

    needed = docs.select(*dict.fromkeys([*extra, "text"]))
    if fits:
        return needed.mapInArrow(run, out)

    key = fresh(docs, "key")[0]
    verdicts = joined_verdicts(docs, bench, window, k, values, key)
    kept = [c for c in extra if c != "doc_id"]
    if not keep_text:  # the text is needed once more, for its key
        extra, keep_text = ["doc_id", "text"], True
        out += ", `text` string"
    base = needed.mapInArrow(run, out).select("doc_id", "n_words", *dict.fromkeys([*kept, "text"])).withColumn(key, text_key())
    joined = base.join(verdicts, key, "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(digest([]))).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"),
        *kept,
    )


def text_key():
    return F.unhex(F.sha2("text", 256))


def joined_verdicts(docs: DataFrame, bench: DataFrame, window: int, k: int, values: np.ndarray, key: str) -> DataFrame:
    """(key, n_hit, n_items, items_sha256, spans, items) of each distinct text with a hit; key is the hash of the text.

    Only the lengths of item runs, at most `window` of them, reach the driver.
    """

    def prints(lengths, short_whole: bool):
        """Distinct (key, n, h) of each row: winnowed hashes of whole windows, all hashes of shorter runs (of items: whole items)."""

        def fn(batches):
            hasher = Words(values)
            for whole in batches:
                for batch in slices(whole, "text"):
                    words, _, _, _, counts = hasher.hashes(*flat_text(batch.column("text")))
                    for n in lengths:
                        if n == window:
                            h, inside = winnow(words, counts, window, k)
                        else:
                            h, inside = grams(words, n), whole_grams(counts, n)
                        places = np.flatnonzero(inside)
                        rows = np.searchsorted(np.cumsum(counts), places, "right")
                        if short_whole and n < window:
                            places, rows = places[counts[rows] == n], rows[counts[rows] == n]
                        order = np.lexsort((h[places], rows))
                        rows, h = rows[order], h[places][order]
                        new = np.append(True, (rows[1:] != rows[:-1]) | (h[1:] != h[:-1]))[: len(rows)]
                        rows, h = rows[new], h[new]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), pa.array(h.view(np.int64))], [key, "n", "h"])

        return fn

    def runs(lengths, whole_items: bool):
        """(key, i, n, run) of every run of n words; of items, n is the one length of their runs."""

        def fn(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    words = words_of(batch.column("text")[at].as_py())
                    for n in [min(window, len(words))] if whole_items else lengths:
                        m = len(words) - n + 1 if n else 0
                        if m > 0:
                            joined = [" ".join(words[i : i + n]) for i in range(m)]
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * m, pa.int64())), pa.array(range(m), pa.int64()), pa.array([n] * m, pa.int32()), pa.array(joined, pa.string())], [key, "i", "n", "run"])

        return fn

    items = bench.where("item_id is not null and text is not null").select(F.col("item_id").alias(key), "text")
    item_type = dict(items.dtypes)[key]
    item_prints = stage(items.mapInArrow(prints(range(1, window + 1), True), f"{key} {item_type}, n int, h long").select("n", "h").distinct(), "item_prints")
    item_runs = stage(items.mapInArrow(runs((), True), f"{key} {item_type}, i long, n int, run string").select("run", F.col(key).alias("item")).distinct(), "item_runs")
    lengths = sorted(r["n"] for r in item_prints.select("n").distinct().collect())

    texts = docs.where("text is not null").select(text_key().alias(key), "text")
    suspects = texts.mapInArrow(prints(lengths, False), f"{key} binary, n int, h long").join(item_prints, ["n", "h"], "left_semi").select(key).distinct()
    suspected = texts.join(suspects, key, "left_semi").groupBy(key).agg(F.first("text").alias("text"))
    found = suspected.mapInArrow(runs(lengths, False), f"{key} binary, i long, n int, run string")
    hits = stage(found.join(item_runs.select("run").distinct(), "run", "left_semi"), "hits")

    def merge(of: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        spans = merged(list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True)))
        return pd.DataFrame({key: [of[0]], "n_hit": [sum(b - a for a, b in spans)], "spans": [[{"a": a, "b": b} for a, b in spans]]})

    spans = hits.select(key, F.col("i").alias("a"), (F.col("i") + F.col("n")).alias("b")).groupBy(key).applyInPandas(merge, f"{key} binary, n_hit long, spans array<struct<a:long,b:long>>")
    held = hits.select(key, "run").distinct().join(item_runs, "run").select(key, "item").distinct()
    ids = held.groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    text_ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return spans.join(ids.select(key, "items", F.size("items").alias("n_items"), F.sha2(F.array_join(text_ids, ","), 256).alias("items_sha256")), key)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage; columns stay as they are."""
    safe = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = decontaminate(docs.withColumnsRenamed(safe), benchmark, keep_text=True).where("not contaminated")
    return found.select(*[F.col(safe.get(c, c)).alias(c) for c in docs.columns])


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import table

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS uid
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
runs AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM runs),
spans AS (
  SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)),
hit AS (SELECT uid, s.n, i, item_id FROM spans s JOIN runs r ON s.n = r.n AND s.run = r.run),
words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT uid, item_id FROM hit) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)
"""
