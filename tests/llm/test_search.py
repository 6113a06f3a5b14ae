"""Top-k search, tokenizer alignment and lexical search against brute force, on hard inputs and on the smallest tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rubrica.llm import alignment, lexical, topk

SF = "/root/testdata/sf0.001"
TOKENIZERS = "/opt/tokenizers"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- top-k ---


def nearest(rows, asks, k=5, scale=256):
    """Every query against every row, in Python integers."""
    known = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(scale * Fraction(x)) for x in v] for _, v in known]
    out = []
    for n, (i, _) in enumerate(known):
        if asks(i):
            scores = [(-sum(a * b for a, b in zip(whole[n], w)), math.inf if known[j][0] is None else known[j][0]) for j, w in enumerate(whole) if j != n]
            out += [(i, r + 1, None if c == math.inf else c, -s) for r, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_topk_on_hard_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 7)]) for i in range(60)]
    hot = rows[7][1]
    rows += [(100 + i, hot) for i in range(40)] + [(200 + i, [0.0] * 7) for i in range(10)]  # copies, among them queries; vectors of zeros
    rows += [(300, None), (310, [None] * 7), (320, [float("nan")] + [0.0] * 6), (330, [float("inf")] + [1.0] * 6), (340, []), (350, [1.0, -1.0]), (None, hot), (None, rows[3][1]), (10, hot), (10, hot), (360, [3e6] * 7), (361, [-2e9] * 3 + [0.0] * 4), (370, [0.5] + [0.0] * 6)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, q int, score int")
    want = nearest([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b in rows], lambda i: i is not None and i % 10 == 0)
    for options in ({}, {"lists": 1}, {"lists": 5}, {"block_bytes": 300}):
        assert rows_of(topk.search(df, F.col("vec_id") % 10 == 0, **options)) == want
    assert rows_of(topk.search(df.limit(3), F.col("vec_id") % 2 == 0, k=9)) == nearest(rows[:3], lambda i: i % 2 == 0, 9)
    assert topk.search(df.limit(0), F.col("vec_id") % 10 == 0).isEmpty()
    assert topk.search(df, F.lit(False)).isEmpty()


def test_topk_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert rows_of(topk.op11_topk(spark, SF)) == sorted(duck.sql(topk.ORACLE).fetchall(), key=str)


# --- alignment ---


def unmapped():
    """Bytes of the characters that a byte-level vocabulary writes: printable ones stand for themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligned(rows):
    """Token spans by the two vocabulary files, links by walking over them."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second, back = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json"), sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model"), unmapped()
    first.encode_special_tokens = True

    def spans(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs, count = [], Counter()
    for doc, text in rows:
        a = [(i, bytes(back[c] for c in first.id_to_token(i))) for i in first.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in (second.encode(text) if text else []) for p in [second.id_to_piece(i)]]
        if not text or b"".join(x for _, x in a) != f" {text}".encode() or b"".join(x for _, x in b) != f" {text}".encode():
            docs.append((doc, [], [], []))
            continue
        a, b, links, j = spans(a), spans(b), [], 0
        for i, start, end in a:
            while b[j][2] <= start:
                j += 1
            links += [(i, b[m][0]) for m in range(j, min(len(b), j + end - start)) if b[m][1] < end]
        count.update(set(links))
        docs.append((doc, a, b, links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc, a, b, links in docs:
        cuts = [0, *sorted({e for *_, e in a} & {e for *_, e in b})]
        inside = lambda side, low, high: ",".join(str(i) for i, _, end in side if low < end <= high)
        groups = ";".join(f"{inside(a, x, y)}|{inside(b, x, y)}" for x, y in zip(cuts, cuts[1:])) if len(a) < 3000 else None
        digest = None if groups is None else hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(cuts) - 1, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=str)


HARD = [
    (1, None), (2, ""), (3, " "), (4, "▁a b"), (5, "a\t\n\r\x00 é é ﬁ 漢字🙂 İ"), (6, "x" + " " * 50_000 + "y"), (None, "hello hello"), (7, "hello hello"), (7, "hello hello"),
    (8, "<s> <|endoftext|> <0x0A>"), (10, "a" * 20_000), (11, "can't won't 1234567 ...!!!   x"), (12, " lead and trail  "),
]


def test_alignment_on_hard_texts(spark):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in HARD], "doc_id long, text string, chunk int, held string")
    got = alignment.align(df).withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    want = aligned(HARD)
    have = [r if w[-1] is not None else (*r[:-1], None) for r, w in zip(rows_of(got), want)]
    assert have == want
    assert alignment.align(df.limit(0)).isEmpty()


def test_small_chunks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    whole = rows_of(alignment.align(df))
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 16)
    assert rows_of(alignment.align(df.repartition(3))) == whole


def test_white_space_beyond_the_fast_encoder():
    """Runs on which the ranks' splitter gives up are encoded by the vocabulary file; other texts alike by both."""
    both = alignment.Tokenizers(TOKENIZERS)
    long = " " * 1_200_000 + "x"
    assert b"".join(both.a[i] for i in both.encode_a(long)) == long.encode() and both.slow is not None
    text = "".join(map(chr, [*range(0x20, 0x3000, 7), *range(0x1F300, 0x1F640)])) + " don't 1 22  x"
    for piece in (text, text[:900]):
        assert both.encode_a(piece) == both.slow.encode(piece, add_special_tokens=False).ids
    assert both.divides


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé1!.\n\t   \u3000\x1c\x85▁漢")), max_size=40))
def test_units_give_the_ids_of_the_whole_text(text):
    """Cutting before the space of a word changes no token on either side."""
    both = alignment.tokenizers(TOKENIZERS)
    cut = alignment.CUT.split(text)
    (a, b), _, fine = both.units(cut)
    if text and fine.all():
        assert a.tolist() == both.encode_a(f" {text}") and b.tolist() == both.piece.encode(text)
    elif text:
        assert b"".join(both.b[i] for i in both.piece.encode(text)) != f" {text}".encode()


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op12_alignment(spark, SF)
    assert got.columns == ["doc_id", *alignment.COUNTS, "groups_sha256"]
    assert [r if w[-1] is not None else (*r[:-1], None) for r, w in zip(rows_of(got), aligned(rows))] == aligned(rows)


# --- lexical search ---

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def lexical_brute(docs, items, k=20):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, words = sum(map(bool, sizes)), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        found = []
        for (doc, bag), n in zip(bags, sizes):
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * (75 + 25 * n * n_docs // words))) for t, times in wanted.items() if t in bag)
            if score > 0:
                found.append((-score, math.inf if doc is None else doc))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("least,shard_bytes,items_at_once", [(32, 1 << 23, 256), (1, 1 << 23, 2), (1, 400, 256)])
def test_lexical_on_hard_texts(spark, monkeypatch, least, shard_bytes, items_at_once):
    """Copies beyond k, ties, nulls, long texts, repeated ids; tiers of one posting, so proofs fail and items fall through; many small shards and blocks."""
    monkeypatch.setattr(lexical, "LEAST", least)
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lexical, "ITEMS", items_at_once)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["Äö", "漢字", "ﬁ", "X9"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 30), p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1))))) for i in range(150)]
    docs += [(1000 + i, "W1 w2, w3! w1") for i in range(50)] + [(5, "w1 äö"), (5, "w1 äö"), (None, "w7 w7"), (None, None), (2000, None), (2001, ""), (2002, "?!"), (2003, "w1 " * 5000 + "rare")]
    items = [("a", "w1 w2 W3"), ("a", "w1 w2 W3"), ("b", "rare X9 x9 nothing"), ("c", None), ("d", "unknown"), (None, "Äö äö 漢字"), ("e", " ".join(words)), ("f", "w7")]
    index = lexical.build(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, shard int"))
    got = lexical.search(index, spark.createDataFrame([(a, b, "x") for a, b in items], "item_id string, text string, id string"))
    assert rows_of(got) == lexical_brute(docs, items)


def test_lexical_index_is_read_in_small_groups(spark, monkeypatch):
    """Rows of the index are megabytes: no row group holds many of them, and no tier shuffles them."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", 100)
    monkeypatch.setattr(lexical, "LEAST", 1)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} some more words of a text {'again ' * (i % 9)}") for i in range(200)], "doc_id long, text string").coalesce(1)
    index = lexical.build(docs)
    files = list(Path(index.shards.staged_at.removeprefix("file:")).glob("*.parquet"))
    groups = [m.row_group(g).num_rows for m in (pq.ParquetFile(f).metadata for f in files) for g in range(m.num_row_groups)]
    assert sum(groups) > 20 and max(groups) <= lexical.GROUP_SHARDS
    told = []
    monkeypatch.setattr(lexical, "answers", lambda index, shards, *rest, f=lexical.answers: told.append(shards) or f(index, shards, *rest))
    assert lexical.search(index, spark.createDataFrame([(1, "w1 w2 again"), (2, "w3 text")], "item_id long, text string")).count() == 40
    plans = [s._jdf.queryExecution().executedPlan().toString() for s in told[1:]]
    assert len(plans) == lexical.TIERS - 1 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


def test_lexical_on_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(docs.limit(0)), items).isEmpty()
    assert lexical.search(lexical.build(docs), items.limit(0)).isEmpty()


def test_lexical_equals_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert rows_of(lexical.op13_lexical(spark, SF)) == sorted(duck.sql(lexical.ORACLE).fetchall(), key=str)
