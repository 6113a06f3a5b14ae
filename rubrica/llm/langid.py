"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces gives every word (a run of letters, lower-cased, with a mark before it)
many segmentations. Each language has a probability for every piece; a word's probability is the sum over
all its segmentations, computed by a forward algorithm, and a text's is the product over its words. Piece
probabilities are learned by expectation maximisation (forward-backward) on word counts.

Runs longer than LONGEST (ordinary in scripts without spaces) are learned from in consecutive parts of that length, and scored whole.
The vocabulary's path is the setting `rubrica.vocabulary`, else VOCABULARY.

Fitting uses at most about `per_lang` training documents of each language, taken by a hash of the text (all
of a language that has fewer); that bound is the only sampling. All documents are scored on their whole
text. Word probabilities are kept per task for at most `CACHE` words.

Defined results: `und` with score 0 for a null text and a text without a letter (and for every text if
nothing can be learned); documents with null id, lang or text are not learned from; held_out is false for a
null id; repeated documents give a row each; equal texts get equal answers; ties go to the language that
sorts first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import VECTOR_SCHEMA, crc_mod, slices, stage, sum_vectors, table, task_id, vector_rows

VOCABULARY = os.environ.get("RUBRICA_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
PER_LANG, ROUNDS, CACHE, LONGEST = 1500, 3, 400_000, 32
UNKNOWN = 1e-8
#: Bytes of text whose words are held at a time; a longer single text is a step of its own.
TEXT_BYTES = 1 << 22


def load_pieces(path: str) -> list[str]:
    """The pieces a lower-cased word can contain, from a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    fits = re.compile(rf"{MARK}?[^\W\d_]*")
    return sorted({p for p in found if p == p.lower() and fits.fullmatch(p)})


def words_of(text: str | None) -> list[str]:
    """Runs of letters; a run of numerals that are no letters does not count."""
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isascii() or any(map(str.isalpha, w))]


def parts_of(word: str) -> list[str]:
    """A marked word in parts of at most LONGEST characters, of which only the first has the mark."""
    word = MARK + word
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


class Lattice:
    """Segmentations of words over the pieces, for arrays of probabilities [piece + 1, language].

    The last row of an array stands for a single character that is no piece.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.n = len(pieces)

    def edges(self, words: list[str], n: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, which words, piece) for marked words of n characters."""
        get, out = self.ids.get, []
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                found = np.array([get(w[start:end], -1) for w in words])
                if end - start == 1:
                    found[found < 0] = self.n
                at = np.flatnonzero(found >= 0)
                if len(at):
                    out.append((start, end, at, found[at]))
        return out

    def forward(self, edges, n: int, count: int, p: np.ndarray) -> np.ndarray:
        alpha = np.zeros((n + 1, count, p.shape[1]))
        alpha[0] = 1
        for start, end, at, piece in edges:
            alpha[end, at] += alpha[start, at] * p[piece]
        return alpha

    def expected(self, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of the weighted parts of words under one language's p[piece + 1, 1]."""
        out = np.zeros(len(p))
        for n, group, at in grouped(words):
            edges = self.edges(group, n)
            alpha = self.forward(edges, n, len(group), p)[:, :, 0]
            beta = np.zeros((n + 1, len(group)))
            beta[n] = 1
            for start, end, rows, piece in reversed(edges):
                beta[start, rows] += beta[end, rows] * p[piece, 0]
            share = weights[at] / np.maximum(alpha[n], 1e-300)
            for start, end, rows, piece in edges:
                np.add.at(out, piece, alpha[start, rows] * p[piece, 0] * beta[end, rows] * share[rows])
        return out

    def log_long(self, word: str, p: np.ndarray) -> np.ndarray:
        """log of the forward sum of one long word, rescaled at each character; memory is bounded."""
        alpha, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
        for end in range(1, len(word) + 1):
            total = np.zeros(p.shape[1])
            for size in range(1, min(self.longest, end) + 1):
                piece = self.ids.get(word[end - size : end], self.n if size == 1 else -1)
                if piece >= 0:
                    total += alpha[-size] * p[piece]
            scale += np.log(total)
            alpha = [a / total for a in alpha[-self.longest :]] + [np.ones(p.shape[1])]
        return scale

    def log_words(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log probability [word, language], summed over all segmentations."""
        out = np.zeros((len(words), p.shape[1]))
        for n, group, at in grouped([MARK + w for w in words]):
            if n > LONGEST:
                out[at] = [self.log_long(w, p) for w in group]
            else:
                out[at] = np.log(self.forward(self.edges(group, n), n, len(group), p)[n])
        return out


def grouped(marked: list[str]):
    """(length, words, their places), at most 8192 words a group."""
    lengths = np.array([len(w) for w in marked])
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        for i in range(0, len(places), 8192):
            at = places[i : i + 8192]
            yield int(n), [marked[j] for j in at], at


class LanguageModel:
    """Learned languages and their piece probabilities."""

    def __init__(self, spark: SparkSession, langs: list[str], pieces: list[str], p: np.ndarray) -> None:
        self.langs, self.p = langs, p
        self.shared = spark.sparkContext.broadcast((langs, pieces, p))

    def predict(self, docs: DataFrame, *keep: str) -> DataFrame:
        """docs with lang_pred and score; only doc_id, text and the columns named in keep."""
        shared = self.shared
        keep = tuple(dict.fromkeys(("doc_id", *keep)))
        fields = {f.name: f.dataType.simpleString() for f in docs.schema}

        def run(batches):
            langs, pieces, p = shared.value
            lattice, ids, logs = Lattice(pieces), {}, np.zeros((0, len(langs)))
            for whole in batches:
                for batch in slices(whole, "text", TEXT_BYTES):
                    lists = [words_of(t) for t in batch.column("text").to_pylist()]
                    for words in lists:
                        for w in set(words).difference(ids):
                            ids[w] = len(ids)
                    new = list(itertools.islice(ids, len(logs), None))
                    if new:
                        logs = np.concatenate([logs, lattice.log_words(new, p)])
                    pred, score = [], []
                    for words in lists:
                        if not words or not langs:
                            pred.append("und")
                            score.append(0.0)
                            continue
                        total = logs[[ids[w] for w in words]].sum(0)
                        total = np.exp(total - total.max())
                        best = int(total.argmax())
                        pred.append(langs[best])
                        score.append(float(total[best] / total.sum()))
                    columns = [batch.column(c) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])
                    if len(ids) > CACHE:
                        ids, logs = {}, np.zeros((0, len(langs)))

        schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", lang_pred string, score double"
        return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def fit(docs: DataFrame, vocabulary: str | None = None, per_lang: int = PER_LANG, rounds: int = ROUNDS) -> LanguageModel:
    """Learn piece probabilities from the training documents (crc32 of the id modulo 4 is not 2)."""
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary or spark.conf.get("rubrica.vocabulary", VOCABULARY))
    train = docs.select("doc_id", "lang", "text").where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel(spark, [], pieces, np.zeros((len(pieces) + 1, 0)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    sampled = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 24)) < share[F.col("lang")] * (1 << 24))

    def count(batches):
        for batch in (part for whole in batches for part in slices(whole, "text", TEXT_BYTES)):
            totals: dict[tuple, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in words_of(text):
                    for part in parts_of(w):
                        totals[lang, part] = totals.get((lang, part), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.string()), pa.array(totals.values(), pa.int64())], ["lang", "word", "n"])

    counted = sampled.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(counted, "words")
    n_pieces = len(pieces) + 1
    p = np.full((n_pieces, len(langs)), 1 / n_pieces)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def expect(batches, now=now):
            lattice, total = Lattice(pieces), np.zeros((len(langs), n_pieces))
            for batch in batches:
                for i, lang in enumerate(langs):
                    own = batch.filter(pc.equal(batch.column("lang"), lang))
                    if own.num_rows:
                        total[i] += lattice.expected(own.column("word").to_pylist(), own.column("n").to_numpy(zero_copy_only=False).astype(float), now.value[:, i : i + 1])
            yield vector_rows(task_id(), total.ravel())

        got = sum_vectors(words.mapInArrow(expect, VECTOR_SCHEMA), words.rdd.getNumPartitions(), p.size, "float64").reshape(len(langs), n_pieces).T
        got[-1] = 0
        p = (got + 0.01) / (got + 0.01).sum(0)
        p[-1] = UNKNOWN
    return LanguageModel(spark, langs, pieces, p)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fit(docs).predict(docs)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is identified with at least that score; columns stay as they are."""
    safe = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    plain = docs.withColumnsRenamed(safe)
    out = fit(plain).predict(plain, *plain.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select(*[F.col(safe.get(c, c)).alias(c) for c in docs.columns])
