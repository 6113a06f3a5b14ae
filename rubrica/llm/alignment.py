"""Alignment of two tokenizers over the same bytes by elementary intervals.

A is a byte-level BPE over a space and the text; B a piece vocabulary with byte fallback, which puts the space before the text itself. The ends of
the tokens of both cut the bytes into elementary intervals (union1d); every interval has one owner on either side (searchsorted) and is one link, an
overlap of an A with a B occurrence. An end that both share closes a group. The number of documents that hold a pair of ids linked is counted over
the corpus, and tells the links that are the most frequent of their A id.

A text is cut into units that begin at the space before a word, over which no token, link or group reaches. The distinct units of a chunk, the documents
of `CHUNK_BYTES` of text at most (a longer text is a chunk of its own), are encoded once and put into the shared folder with the documents as sequences of units.
A chunk sends each of its pairs once, with its documents, so that no pair has more rows than there are chunks; the counts come back to the
chunk by a join on its number. Only the highest count of each A id, a row per entry of the vocabulary, is broadcast.

A is encoded by the ranks of the same vocabulary, which give the same ids faster (tests compare them); runs of white space that those cannot take are
encoded by the vocabulary file of A itself.

Defined results: a text that is null, empty, or altered by a tokenizer has no tokens; its counts are 0 and its groups ''. Repeated rows count as
documents of their own, a null id stays null. An empty table gives no rows, further columns are ignored, texts are taken whole. A token without a
partner does not exist, since both cover all bytes.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrica.llm.common import slices, stage, table, task_id

FOLDER = os.environ.get("RUBRICA_TOKENIZERS", "/opt/tokenizers")
CHUNK_BYTES = 1 << 20
SIDES = ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")
# Fixed value: how the byte-level vocabulary splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATORS = (b",", b"|", b";", b"")
#: No token of either side holds both the end of a word and the space behind it, so a text is encoded in units that begin there.
CUT = re.compile(r"(?<=\S) ")
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Tokenizers:
    """Both vocabularies: encoders, and the bytes of every entry."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{SIDES[0]}", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.folder, self.slow = folder, None
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.piece = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{SIDES[2]}")
        self.a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a[rank] = token
        self.b = [bytes([int(p[3:5], 16)]) if self.piece.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.piece.get_piece_size()) for p in [self.piece.id_to_piece(i)]]
        self.size_a, self.size_b = (np.array([len(t) for t in side], np.int64) for side in (self.a, self.b))
        self.kind = np.uint16 if max(len(self.a), len(self.b)) <= 1 << 16 else np.uint32
        inner = (self.piece.id_to_piece(i).lstrip("▁") for i in range(len(self.b)))
        self.divides = not any("▁" in p for p in inner)  # no piece reaches over the space before a word

    def encode_a(self, text: str) -> list[int]:
        if len(text) < 1000:
            return self.fast.encode_ordinary(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).tolist()
        except ValueError:  # a run of white space beyond what its splitter can go back over
            pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(f"{self.folder}/{SIDES[1]}")
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def units(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids and their number for a space and each unit, on both sides; and the units whose bytes both give back, for the others have no ids."""
        raw = [f" {u}".encode() for u in units]
        fine = np.ones(len(units), bool)
        space = [self.piece.piece_to_id("▁")]  # of a last space, for the encoder puts none before an empty text
        sides = [self.encode_a(f" {u}") for u in units], [ids or space for ids in self.piece.encode(units, num_threads=1)]
        for lists, entries in zip(sides, (self.a, self.b), strict=True):
            if b"".join(map(entries.__getitem__, itertools.chain.from_iterable(lists))) != b"".join(raw):
                fine &= [b"".join(map(entries.__getitem__, ids)) == r for ids, r in zip(lists, raw, strict=True)]
        if not fine.all():
            sides = [[ids if ok else [] for ids, ok in zip(lists, fine.tolist(), strict=True)] for lists in sides]
        flat = [np.fromiter(itertools.chain.from_iterable(lists), self.kind) for lists in sides]
        return flat, [np.array([len(ids) for ids in lists], np.int64) for lists in sides], fine


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of runs of the given sizes, one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


@lru_cache(maxsize=2)
def written(size: int) -> tuple[list[bytes], np.ndarray]:
    """Decimal ids with every separator behind them, and their lengths."""
    texts = [b"%d" % i + s for i in range(size) for s in SEPARATORS]
    return texts, np.array([len(t) for t in texts], np.int64)


class Units:
    """Links and groups of distinct units of text; places are offsets into the bytes of all of them. No link or group reaches over a unit's ends."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, both: Tokenizers) -> None:
        self.a, self.b, self.n_a, self.n_b, self.width = a, b, n_a, n_b, len(both.b)
        self.end_a, self.end_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
        edges = union1d(self.end_a, self.end_b)
        owner_a, owner_b = np.searchsorted(self.end_a, edges), np.searchsorted(self.end_b, edges)
        self.shared = edges[(self.end_a[owner_a] == edges) & (self.end_b[owner_b] == edges)]
        unit_a = np.repeat(np.arange(len(n_a)), n_a)
        self.pair = a[owner_a].astype(np.int64) * self.width + b[owner_b]
        self.links = np.bincount(unit_a[owner_a], minlength=len(n_a))
        self.groups = np.bincount(unit_a[np.searchsorted(self.end_a, self.shared)], minlength=len(n_a))
        self.first = np.cumsum(self.links) - self.links

    def texts(self) -> list[bytes]:
        """Each unit's groups as `a1,a2|b1;a3|b2,b3`."""
        group_a, group_b = np.searchsorted(self.shared, self.end_a), np.searchsorted(self.shared, self.end_b)
        n = len(self.shared)
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[group_b]
        kind = np.zeros(len(self.a) + len(self.b), np.int64)
        kind[place_a[np.cumsum(in_a) - 1]], kind[place_b[np.cumsum(in_b) - 1]] = 1, 2
        ends = np.cumsum(self.n_a + self.n_b)
        kind[ends[self.n_a > 0] - 1] = 3
        ids = np.empty(len(kind), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        table_, sizes = written(1 << int(max(self.a.max(initial=0), self.b.max(initial=0))).bit_length())
        ids = ids * len(SEPARATORS) + kind
        data = b"".join(map(table_.__getitem__, ids.tolist()))
        at = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], ends])].tolist()
        return [data[x:y] for x, y in zip(at, at[1:])]


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.union1d of two sorted arrays, by a merge; numpy's own hashes and then sorts, which takes ten times as long."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])[: len(both)]]


class Chunk:
    """Documents as sequences of units."""

    def __init__(self, row: dict, both: Tokenizers) -> None:
        a, b = (unpacked(row[s], both.kind) for s in ("a", "b"))
        self.units = Units(a, b, unpacked(row["n_a"], np.int64), unpacked(row["n_b"], np.int64), both)
        self.codes, self.sizes = unpacked(row["codes"], np.int32), unpacked(row["sizes"], np.int64)

    def summed(self, per_unit: np.ndarray) -> np.ndarray:
        """Sums of a value per unit over each document."""
        total, end = np.append(0, np.cumsum(per_unit[self.codes])), np.cumsum(self.sizes)
        return total[end] - total[end - self.sizes]

    def holders(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs, and the documents of the chunk that hold each."""
        u, bits = self.units, max(1, len(self.sizes).bit_length())
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        seen = np.sort(doc << 32 | self.codes)
        seen = seen[np.append(True, seen[1:] != seen[:-1])[: len(seen)]]
        code, doc = seen & (1 << 32) - 1, seen >> 32
        keys = np.sort(u.pair[ragged(u.first[code], u.links[code])] << bits | np.repeat(doc, u.links[code]))
        pair = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]] >> bits
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        return pair[first], np.diff(np.append(first, len(pair)))

    def texts(self) -> pa.Array:
        of, codes, at, out = self.units.texts(), self.codes.tolist(), 0, []
        for n in self.sizes.tolist():
            out.append(b";".join([of[c] for c in codes[at : at + n]]))
            at += n
        return pa.array(out, pa.binary()).cast(pa.string())


PACKED = ("codes", "sizes", "a", "b", "n_a", "n_b")


def packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed, behind their number."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)


def encoded(docs: DataFrame, id_column: str, folder: str) -> DataFrame:
    """The documents as units, and the token ids of the distinct units, a row per chunk; staged."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizers(folder), task_id() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                index: dict[str, int] = {}
                codes = [[index.setdefault(u, len(index)) for u in (CUT.split(t) if both.divides else [t])] if (t := text.as_py()) else [] for text in part.column("text")]
                (a, b), (n_a, n_b), fine = both.units(list(index))
                if not fine.all():
                    codes = [c if fine[c].all() else [] for c in codes]
                flat = np.fromiter(itertools.chain.from_iterable(codes), np.int32)
                blobs = [flat, np.array([len(c) for c in codes], np.int64), a, b, n_a, n_b]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *[pa.array([packed(x)], pa.binary()) for x in blobs]], ["chunk", "ids", *PACKED])
                number += 1

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col("text"))
    return stage(rows.mapInArrow(run, f"chunk long, ids array<{kind}>, {', '.join(f'{c} binary' for c in PACKED)}"), "encoded")


def linked(chunks: DataFrame, folder: str) -> DataFrame:
    """(chunk, a, b, n): the pairs of each chunk and how many of its documents hold them linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(folder)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk({c: batch.column(c)[row].as_py() for c in PACKED}, both)
                pair, n = chunk.holders()
                columns = [np.full(len(pair), batch.column("chunk")[row].as_py()), (pair // len(both.b)).astype(np.int32), (pair % len(both.b)).astype(np.int32), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "a", "b", "n"])

    return chunks.select("chunk", *PACKED).mapInArrow(run, "chunk long, a int, b int, n long")


def align(docs: DataFrame, *, id_column: str = "doc_id", folder: str = FOLDER) -> DataFrame:
    """One row per document: its id, tokens of both sides, groups, links, the links that are the most frequent of their A id, the sum of the links' counts, and the groups."""
    kind = dict(docs.dtypes)[id_column]
    chunks = encoded(docs, id_column, folder)
    held = linked(chunks, folder).withColumn("held", F.sum("n").over(Window.partitionBy("a", "b"))).drop("n")
    held = stage(held, "held")
    most = held.groupBy("a").agg(F.max("held").alias("most"))  # a row per entry of the vocabulary
    counts = held.join(F.broadcast(most), "a").withColumn("is_best", F.col("held") == F.col("most")).drop("most")
    schema = f"`{id_column}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, `groups` string"

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        both = tokenizers(folder)
        pair = right.column("a").to_numpy().astype(np.int64) * len(both.b) + right.column("b").to_numpy()
        order = np.argsort(pair)
        pair, counted = pair[order], [right.column(c).to_numpy()[order].astype(np.int64) for c in ("is_best", "held")]
        parts = []
        for row in range(left.num_rows):
            chunk = Chunk({c: left.column(c)[row].as_py() for c in PACKED}, both)
            u = chunk.units
            at, sums = np.minimum(np.searchsorted(pair, u.pair), max(0, len(pair) - 1)), []  # units of texts without tokens have no counts
            for values in counted:
                total = np.append(0, np.cumsum(values[at] if len(pair) else np.zeros(len(at), np.int64)))
                sums.append(total[u.first + u.links] - total[u.first])
            ids = left.column("ids").combine_chunks().slice(row, 1).flatten()
            columns = [ids, *[pa.array(chunk.summed(x)) for x in (u.n_a, u.n_b, u.groups, u.links, *sums)], chunk.texts()]
            parts.append(pa.Table.from_arrays(columns, [id_column, *COUNTS, "groups"]))
        return pa.concat_tables(parts)

    return chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(tell, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"))
    return out.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
