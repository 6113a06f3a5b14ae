"""Quality classification by positive-unlabelled learning.

A linear model over text features minimises the non-negative unbiased risk: with class prior p, risk of the
positives R_p+, and negative risks R_p- and R_u- of positives and unlabelled texts, it descends p R_p+ +
max(0, R_u- - p R_p-); where the second part is negative, its gradient is turned round instead. The prior is
estimated from the scores of a first fit: the least ratio of unlabelled to positive mass above a threshold.

Trusted positives are training documents (crc32 of the id modulo 5 is not 0) whose labels all say 1; every
document may serve as unlabelled text. At most about POSITIVES and UNLABELLED documents, taken by a hash of
id and text, are used to fit; that bound is the only sampling. labels of 0, lang, source and ids are no inputs.

Features: relative frequencies of bytes and hashed byte pairs, lengths, shares of upper case, of symbols, of
words repeated in a row, of distinct words and of words of one byte, the longest run of one word. Defined results: a null or empty text has the features of no
bytes and a score like any other; without positives all scores are 0.5; held_out is false for a null id;
repeated documents give a row each, equal texts equal scores; an empty table gives no rows; extra columns are
ignored; texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import Words, byte_table, crc_mod, flat_text, slices, space_bytes, table

POSITIVES, UNLABELLED, PAIRS, CUT = 4000, 8000, 256, 0.3
FAR, LEAST_STD = 8, 3e-2
SIZE = 256 + PAIRS + 12


def features(column: pa.Array, hasher: Words) -> np.ndarray:
    """float32 [row, SIZE] of a slice of texts."""
    data, offsets = flat_text(column)
    n, sizes = len(column), np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    by_byte = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32)
    pair = (data[:-1].astype(np.uint32) * np.uint32(2654435761) + data[1:].astype(np.uint32) * np.uint32(2246822519)) >> np.uint32(24)
    inside = row[:-1] == row[1:]
    by_pair = np.bincount(row[:-1][inside] * PAIRS + pair[inside].astype(np.int64) % PAIRS, minlength=n * PAIRS).reshape(n, PAIRS).astype(np.float32)
    words, starts, ends, first, counts = hasher.hashes(data, offsets)
    owner = np.repeat(np.arange(n), counts)
    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner[1:][same], minlength=n)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    distinct = np.bincount((keys[np.append(True, keys[1:] != keys[:-1])] >> np.uint64(40)).astype(np.int64), minlength=n) if len(keys) else np.zeros(n)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = np.bincount(owner, weights=np.isin(last, np.frombuffer(b"!#$%&*+/<=>@\\^_|~", np.uint8)), minlength=n)
    shout = np.bincount(owner, weights=(data[starts] >= 65) & (data[starts] <= 90) if len(starts) else None, minlength=n) if len(owner) else np.zeros(n)
    begin = np.flatnonzero(np.append(True, ~same)) if len(words) else np.zeros(0, np.int64)  # of runs of one word
    longest = np.zeros(n)
    np.maximum.at(longest, owner[begin], np.diff(np.append(begin, len(words))))
    short = np.bincount(owner[(ends - starts) == 1], minlength=n)
    size, count = np.maximum(sizes, 1), np.maximum(counts, 1)
    upper = by_byte[:, 65:91].sum(1)
    more = [np.log1p(sizes), np.log1p(counts), (ends - starts).sum() and np.bincount(owner, weights=ends - starts, minlength=n) / count, again / count, distinct / count, upper / size, odd / count, shout / count]
    more += [np.sqrt(again / count), np.log1p(longest), np.sqrt(odd / count), np.sqrt(short / count)]
    out = np.empty((n, SIZE), np.float32)
    out[:, :256] = np.sqrt(by_byte / size[:, None])
    out[:, 256 : 256 + PAIRS] = np.sqrt(by_pair / size[:, None])
    for i, x in enumerate(more):
        out[:, 256 + PAIRS + i] = x
    return out


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, batch: int = 512, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights (bias last) of least non-negative risk with logistic loss, by Adam."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), batch)]
        u = unlabelled[rng.integers(0, len(unlabelled), batch)]
        fp, fu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        toward = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        gradient = prior * (p.T @ (sp - 1)) / len(p) + toward if negative >= 0 else -toward
        gradient = gradient + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The least ratio of the shares of unlabelled and positive scores above a threshold, with its error bound."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + error) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def sampled(docs: DataFrame, bound: int, total: int) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) < min(1.0, bound / max(1, total)) * (1 << 24))


def measured(docs: DataFrame) -> np.ndarray:
    """Features of a bounded sample, gathered on the driver; equal rows, which a hash takes together, count once."""
    values = byte_table(space_bytes(), 3)

    def run(batches):
        hasher = Words(values)
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"), hasher)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    once = docs.withColumn("key", F.xxhash64("doc_id", "text")).dropDuplicates(["key"])
    got = once.select("text").mapInArrow(run, "x binary").collect()
    return np.frombuffer(b"".join(sorted(bytes(r["x"]) for r in got)), np.float32).reshape(-1, SIZE)


class Scaler:
    """Features as deviations from those of trusted positives, which a text of another kind leaves far behind."""

    def __init__(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), 1 / (x.std(0) + LEAST_STD)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.append(np.clip((x - self.mean) * self.scale, -FAR, FAR), np.ones((len(x), 1), np.float32), axis=1)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """(scaler, weights, prior), or None without positives."""
    marks = labels.select("doc_id", "quality").where((crc_mod("doc_id", 5) != 0) & F.col("quality").isNotNull())
    trusted = marks.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    n = trusted.count()
    if not n:
        return None
    share = min(1.0, positives / n)
    chosen = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < share * (1 << 24))  # about `positives` ids: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    p = measured(sampled(rows, 2 * positives, rows.select(F.xxhash64("doc_id", "text")).distinct().count()))  # an id may stand on any number of texts
    u = measured(sampled(docs.select("doc_id", "text"), unlabelled, docs.count()))
    if not len(p) or not len(u):
        return None
    scaler = Scaler(p)
    p, u = scaler(p).astype(np.float64), scaler(u).astype(np.float64)
    half = len(p) // 2 or 1
    first = minimise(p[:half], u, 0.5)
    prior = estimate_prior(p[half:] @ first if len(p) > 1 else p @ first, u @ first)
    return scaler, minimise(p, u, prior), prior


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every document: the estimated probability of quality 1."""
    values = byte_table(space_bytes(), 3)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model[0].mean, model[0].scale, model[1]))

    def run(batches):
        hasher = Words(values)
        for whole in batches:
            for batch in slices(whole, "text"):
                if shared.value is None:
                    out = np.full(batch.num_rows, 0.5)
                else:
                    mean, scale, w = shared.value
                    x = np.clip((features(batch.column("text"), hasher) - mean) * scale, -FAR, FAR)
                    # each row on its own, so that equal texts get equal bits wherever they stand
                    z = np.array([float(np.dot(r.astype(np.float64), w[:-1])) for r in x]) + w[-1]
                    out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
