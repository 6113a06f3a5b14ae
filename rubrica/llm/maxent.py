"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(w | h) = P(class(w) | h) * P(w | class(w)). The class softmax is log-linear in hashed features of the
history: the last word, the last two, the words two and three places back (skips), and the ending of the last
word. Classes are clusters of word endings by the endings before them, so any word has one; the end of a text has
class 0 to itself. Within a class, bias features only: P(w | class) = (c + 1) / (N_class + V_class + 1).

Counts c cover every training document. Words are counted as 64-bit hashes per block of documents, summed over the
blocks where they meet in one shuffle by hash, and scoring meets each block with the counts of its own words only, so no vocabulary is
broadcast. Classes and weights are learned from every position of every training document; features are computed again from
the staged texts in each pass, so none are stored. The feature tables grow with the training tokens up to a bound
(LARGEST rows). Weights start from the first step of gradient ascent that has a closed form: the counts of feature and class
over all positions against what the class shares alone expect. Then each task descends from the shared weights over its
share of the positions, and the weights are averaged by their number, for EPOCHS rounds. Documents are dealt to tasks by
a hash of id and text and sorted by it, so the model does not depend on how the input is cut into files. Scoring works on numpy batches of sparse features.

Defined results: a null or empty text has one token, its end; held_out is false for a null id, which is not learned
from; without training text all scores are 0; repeated rows give a row each, equal texts equal scores; an empty
table gives no rows; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrica.llm.common import VECTOR_SCHEMA, Words, byte_table, crc_mod, drop, flat_text, mix, slices, space_bytes, stage, sum_vectors, table, task_id, vector_rows

BLOCK_BYTES, EPOCHS, CLASSES = 24 << 20, 1, 32
ENDINGS, CONTEXTS, TABLES = 4096, 256, 5
#: Rows of a feature table: as many as there are training tokens per TOKENS_A_ROW, between these two.
SMALLEST, LARGEST, TOKENS_A_ROW = 1 << 12, 1 << 16, 1 << 15
#: Training tokens of a task for each row of a table, so that weights are small beside the text they come from.
TASK_TOKENS = 750
STEP, RATE, START = 1 << 16, 0.3, 0.3
END_ENDING = ENDINGS
RESERVED = np.uint64(0x5851F42D4C957F2D)


def table_rows(total: int) -> int:
    return min(LARGEST, max(SMALLEST, 1 << max(0, total // TOKENS_A_ROW - 1).bit_length()))


class Tokens:
    """Words of a slice with an end after each row: hashes, endings and features, flat."""

    def __init__(self, rows: int = 0) -> None:
        self.words, self.rows = Words(byte_table(space_bytes(), 1)), rows

    def __call__(self, column: pa.Array):
        """(hashes, endings, endings of the last words, features or null, tokens of each row)."""
        data, offsets = flat_text(column)
        h, starts, ends, first, counts = self.words.hashes(data, offsets)
        n, rows = len(h) + len(counts), len(counts)
        lengths = counts + 1
        stop = np.cumsum(lengths) - 1
        is_end = np.zeros(n, bool)
        is_end[stop] = True
        hashes = np.full(n, RESERVED, np.uint64)
        hashes[~is_end] = h
        code = self.words.values[data]
        tail = np.zeros(len(h), np.uint64)
        for j in range(1, 4):
            at = ends - j
            inside = at >= starts
            tail = tail * np.uint64(0x9E3779B97F4A7C15)
            tail[inside] += code[at[inside]]
        endings = np.full(n, END_ENDING, np.int32)
        endings[~is_end] = (mix(tail) % np.uint64(ENDINGS)).astype(np.int32)
        place, begin = np.arange(n), np.repeat(stop - counts, lengths)
        last = np.full(n, END_ENDING, np.int32)
        have = place > begin
        last[have] = endings[place[have] - 1]
        if not self.rows:
            return hashes, endings, last, None, lengths
        back = []
        for j in range(1, 4):
            prior = np.full(n, RESERVED + np.uint64(j), np.uint64)
            have = place - j >= begin
            prior[have] = hashes[place[have] - j]
            back.append(prior)
        one, two, three = back
        keys = (one, mix(one) + two * np.uint64(3), two * np.uint64(5) + np.uint64(1), three * np.uint64(7) + np.uint64(2), last.astype(np.uint64) + np.uint64(3))
        features = np.empty((n, TABLES), np.int32)
        for j, key in enumerate(keys):
            features[:, j] = (mix(key) & np.uint64(self.rows - 1)).astype(np.int32) + j * self.rows
        return hashes, endings, last, features, lengths


def blocked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, train, block), staged: blocks of about BLOCK_BYTES of text, whole rows."""

    def number(batches):
        used, block = 0, task_id() << 32
        for whole in batches:
            for batch in slices(whole, "text"):
                if used > BLOCK_BYTES:
                    used, block = 0, block + 1
                used += batch.column("text").nbytes
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([block] * batch.num_rows, pa.int64())], [*batch.schema.names, "block"])

    kept = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 7) != 2, F.lit(False)).alias("train"))
    return stage(kept.mapInArrow(number, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, train boolean, block long"), "blocked")


def counted(rows: DataFrame) -> DataFrame:
    """Per block and task: (block, h, ending, n) of its words, staged."""

    def run(batches):
        tokens, held, block, seen = Tokens(), [], None, 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            e = np.concatenate([x[2] for x in held])
            keys, at = np.unique(h, return_index=True)
            total = np.bincount(np.searchsorted(keys, h), weights=n, minlength=len(keys)).astype(np.int64)
            return keys, e[at], total

        def out(block, got):
            keys, e, total = got
            m = len(keys)
            return pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), pa.array(keys.view(np.int64)), pa.array(e), pa.array(total)], ["block", "h", "ending", "n"])

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids = batch.column("block").to_pylist()
                cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if block is not None and ids[a] != block and held:
                        yield out(block, flush())
                        held, seen = [], 0
                    block, part = ids[a], batch.slice(a, b - a)
                    hashes, endings, _, _, lengths = tokens(part.column("text"))
                    train = np.repeat(part.column("train").to_numpy(zero_copy_only=False).astype(bool), lengths)
                    keys, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                    held.append((keys, np.bincount(inverse, weights=train, minlength=len(keys)).astype(np.int64), endings[at]))
                    seen += len(keys)
                    if seen > 1_500_000:
                        k, e, t = flush()
                        held, seen = [(k, t, e)], len(k)
        if held:
            yield out(block, flush())

    return stage(rows.mapInArrow(run, "block long, h long, ending int, n long"), "counted")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The training texts in n parts by a hash of id and text, sorted by it, staged: the same parts for any layout of the input."""
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    kept = rows.where("train").select("text", key.alias("key"))
    return stage(kept.repartition(n, "key").sortWithinPartitions("key", "text").select("text"), "samples")


def positions_of(batches, rows: int = 0):
    """(endings, endings of the last words, features) of all positions of the texts, slice by slice."""
    tokens = Tokens(rows)
    for whole in batches:
        for batch in slices(whole, "text", 1 << 19):
            _, endings, last, features, _ = tokens(batch.column("text"))
            yield endings, last, features


def learn_classes(samples: DataFrame, parts: int, classes: int = CLASSES) -> np.ndarray:
    """The class of each ending: k-means over the endings that stand before it; class 0 is the end's own."""
    size = (ENDINGS + 1) * CONTEXTS

    def count(batches):
        total = np.zeros(size, np.int64)
        for endings, last, _ in positions_of(batches):
            total += np.bincount(endings.astype(np.int64) * CONTEXTS + last % CONTEXTS, minlength=size)
        yield vector_rows(task_id(), total.astype(np.int32))

    seen = sum_vectors(samples.mapInArrow(count, VECTOR_SCHEMA), parts, size, "int32", total="int64").reshape(-1, CONTEXTS)[:ENDINGS].astype(float)
    mass = seen.sum(1)
    x = np.sqrt((seen + seen.sum(0) / max(1, seen.sum()) * 2) / (mass[:, None] + 2))
    apart = lambda c: np.maximum(0, (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T)
    centre = x[[int(mass.argmax())]]
    for _ in range(classes - 2):  # farthest first, by mass
        centre = np.append(centre, x[[int((apart(centre).min(1) * mass).argmax())]], axis=0)
    for _ in range(12):
        own = apart(centre).argmin(1)
        for c in range(len(centre)):
            if mass[own == c].sum():
                centre[c] = np.average(x[own == c], axis=0, weights=mass[own == c])
    return np.append(own + 1, 0).astype(np.int64)


def first_step(samples: DataFrame, parts: int, classes: np.ndarray, prior: np.ndarray, rows: int) -> np.ndarray:
    """Weights of the first step: log of seen against expected counts of each feature and class, shared among the tables."""
    size = TABLES * rows * len(prior)

    def count(batches):
        total = np.zeros(size, np.int64)
        for endings, _, features in positions_of(batches, rows):
            own = classes[endings]
            for j in range(TABLES):
                total[j * rows * len(prior) : (j + 1) * rows * len(prior)] += np.bincount((features[:, j] - j * rows) * len(prior) + own, minlength=rows * len(prior))
        yield vector_rows(task_id(), total.astype(np.int32))

    seen = sum_vectors(samples.mapInArrow(count, VECTOR_SCHEMA), parts, size, "int32", total="int64").reshape(-1, len(prior)).astype(float)
    weights = np.zeros((TABLES * rows + 1, len(prior)), np.float32)
    weights[:-1] = START * np.log((seen + 1) / (seen.sum(1, keepdims=True) * prior + 1))
    weights[-1] = np.log(prior)
    return weights


def log_softmax(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """[position, class] log probabilities; the last row of the weights is the bias."""
    z = weights[features[:, 0]] + weights[-1]
    for j in range(1, features.shape[1]):
        z += weights[features[:, j]]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def descend(weights: np.ndarray, classes: np.ndarray, features: np.ndarray, squares: np.ndarray, rate: float) -> None:
    """One gradient step in place (AdaGrad), on the rows that the batch has."""
    n, size = len(classes), (len(weights) - 1) // features.shape[1]
    error = np.exp(log_softmax(weights, features))
    error[np.arange(n), classes] -= 1
    error *= np.float32(1 / n)
    for j in range(features.shape[1]):
        order = np.argsort((features[:, j] - j * size).astype(np.uint16), kind="stable")  # a radix sort, as LARGEST allows
        rows = features[order, j]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        gradient, at = np.add.reduceat(error[order], first), rows[first]
        squares[at] += gradient**2
        weights[at] -= np.float32(rate) * gradient / (np.sqrt(squares[at]) + np.float32(1e-7))
    gradient = error.sum(0)
    squares[-1] += gradient**2
    weights[-1] -= np.float32(rate) * gradient / (np.sqrt(squares[-1]) + np.float32(1e-7))


def train(samples: DataFrame, parts: int, classes: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights [TABLES * rows + 1, class] of the class softmax, by averaged distributed descent from the given ones."""
    sc, rows = samples.sparkSession.sparkContext, (len(weights) - 1) // TABLES
    for epoch in range(epochs):
        shared = sc.broadcast(weights)

        def run(batches, shared=shared, epoch=epoch):
            w, squares, n, held = shared.value.copy(), np.zeros(shared.value.shape, np.float32), 0, []

            def step():
                own, x = np.concatenate([e for e, _ in held]), np.concatenate([f for _, f in held])
                held.clear()
                descend(w, classes[own], x, squares, RATE / (1 + epoch))
                return len(x)

            for endings, _, features in positions_of(batches, rows):
                for i in range(0, len(endings), STEP):
                    held.append((endings[i : i + STEP], features[i : i + STEP]))
                    if sum(len(e) for e, _ in held) >= STEP:
                        n += step()
            if held:
                n += step()
            yield vector_rows(task_id(), np.append(w.ravel().astype(np.float64) * n, n).astype(np.float32))

        got = sum_vectors(samples.mapInArrow(run, VECTOR_SCHEMA), parts, weights.size + 1, "float32", total="float64")
        if got[-1] <= 0:
            break
        weights = (got[:-1] / got[-1]).reshape(weights.shape).astype(np.float32)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    id_type = dict(docs.dtypes)["doc_id"]
    spark: SparkSession = docs.sparkSession
    rows = blocked(docs)
    words = counted(rows)
    meeting = Window.partitionBy("h")  # a row for each block that has the word
    first = F.row_number().over(meeting.orderBy("block")) == 1
    counts = stage(words.select("block", "h", "ending", F.sum("n").over(meeting).alias("c"), first.alias("first")).where("c > 0"), "counts")
    by_ending = {r["ending"]: (r["n"], r["v"]) for r in counts.where("first").groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # at most ENDINGS + 1 rows
    total, distinct = sum(n for n, _ in by_ending.values()), sum(v for _, v in by_ending.values())
    n_rows = table_rows(total)
    n_tasks = max(1, total // (TASK_TOKENS * n_rows))
    if total:
        samples = dealt(rows, n_tasks)
        classes = learn_classes(samples, n_tasks)
    else:
        classes = np.append(np.ones(ENDINGS, np.int64), 0)
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for ending, (n, v) in sorted(by_ending.items()):
        n_class[classes[ending]] += n
        v_class[classes[ending]] += v
    prior = (n_class + 1) / (n_class + 1).sum()
    weights = train(samples, n_tasks, classes, first_step(samples, n_tasks, classes, prior, n_rows)) if total else np.zeros((TABLES * n_rows + 1, CLASSES), np.float32)
    if total:
        drop(samples)
    drop(words)
    model = spark.sparkContext.broadcast((classes, weights, n_class, v_class))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        classes, weights, n_class, v_class = model.value
        order = np.argsort(known := right.column("h").to_numpy().view(np.uint64))
        known, count = known[order], right.column("c").to_numpy()[order]
        tokens, out = Tokens(n_rows), []
        left = left.combine_chunks()
        for whole in left.to_batches():
            for batch in slices(whole, "text", 1 << 19):
                hashes, endings, _, features, lengths = tokens(batch.column("text"))
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                c = np.where(known[at] == hashes, count[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
                own = classes[endings]
                begin = np.cumsum(lengths) - lengths
                add = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)  # noqa: E731, B023
                base = np.log10((c + 1) / (total + distinct + 1))
                if total:
                    in_class = np.log10((c + 1) / (n_class[own] + v_class[own] + 1))
                    model_score = in_class + log_softmax(weights, features)[np.arange(len(own)), own].astype(np.float64) / np.log(10)
                else:
                    model_score = base
                out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), pa.array(lengths.astype(np.int64)), pa.array(add((c > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(lengths), total, np.int64)), pa.array(add(base).astype(np.float64)), pa.array(add(model_score).astype(np.float64))], NAMES))
        return pa.Table.from_batches(out) if out else pa.table({n: [] for n in NAMES})

    held = rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(False)).otherwise(~F.col("train")).alias("held"), "block")
    needed = counts.select("block", "h", "c")
    return held.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
