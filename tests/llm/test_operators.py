"""The llm operators on small fixtures: brute force, round trips, and hard inputs."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rubrica.llm import decontaminate, graph, langid, mainpage, maxent, mixing, mpeg, neardup, quality, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, items string"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the old dark forest tonight"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (0, BASE, "en", "a"), (1, BASE, "en", "a"), (2, BASE + " again", "en", None), (2, BASE + " again", "en", None), (None, None, None, None), (3, "", None, "b"),
    (4, "...", "en", "b"), (5, LONG, "en", "b"), (6, "eins zwei drei. vier fünf sechs. sieben acht neun zehn elf zwölf dreizehn.", "de", "a"), (7, None, "de", "a"), (None, "kurz", "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 0.5, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(BASE.split()[3:16])), (2, "vier fünf sechs"), (None, "the"), (3, None)], "item_id long, text string")


def test_decontamination(docs, none, bench):
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert {(0, 22, 13, 1), (6, 13, 3, 1), (3, 0, 0, 0), (None, 0, 0, 0)} <= got
    assert decontaminate.decontaminate(none, bench).isEmpty()
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").isEmpty()
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 5
    key = lambda df: sorted(map(str, df.select("doc_id", "n_words", "n_hit", "items_sha256").collect()))
    assert key(decontaminate.decontaminate(docs, bench, block_chars=20)) == key(decontaminate.decontaminate(docs, bench))


def test_joined_fingerprints_equal_the_broadcast_block(spark):
    """Short items, repeated and null ids, null texts, copies, upper case, columns named like inner ones: both ways give every column alike."""
    passage = " ".join(f"w{i}" for i in range(30))
    items = [("b", passage), ("b", passage), ("a", "w5 W6 w7"), (None, "zz yy"), ("c", None), ("d", ""), ("e", " ".join(f"w{i}" for i in range(8, 19)) + " other"), ("f", "äö. ü")]
    texts = [passage, passage, passage.upper(), "x " * 40 + passage[20:90] + " y", "w5, w6! w7", "zz yy", "äö ü", None, None, "", "w5 w6", f"{passage} {passage}"]
    docs = spark.createDataFrame([(i % 10 or None, t, i, "n") for i, t in enumerate(texts)], "doc_id long, text string, key int, n_hits string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for keep in (False, True):
        near, far = (decontaminate.decontaminate(docs, bench, block_chars=c, keep_text=keep) for c in (10**6, 0))
        assert near.columns == far.columns and [t for _, t in near.dtypes] == [t for _, t in far.dtypes]
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    assert near.where("contaminated").count() == 7 and near.where("n_hit = 60").count() == 1
    empty = decontaminate.decontaminate(docs.limit(0), bench, block_chars=0)
    assert empty.isEmpty() and empty.columns == decontaminate.decontaminate(docs, bench).columns


def test_joined_fingerprints_on_whole_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    near, far = (sorted(map(str, decontaminate.decontaminate(docs, bench, block_chars=c).collect())) for c in (10**6, 0))
    assert near == far and any("contaminated=True" in r for r in near)


def test_near_duplicates(docs, none):
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(c for d, c in got if d in (0, 1, 2)) == [0, 0, 0, 0] and (5, 5) in got and (3, 3) in got
    assert got.count((None, None)) == 2
    assert neardup.near_duplicates(none).isEmpty()
    kept = neardup.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "4", "5", "6", "7", "None", "None"] and kept.columns == docs.columns


def test_large_near_copy_group_equals_all_pairs(spark):
    """Copies with 0 to 12 replaced words: the classes are the components of every link among all pairs."""
    import random

    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 6, 8, 12])):
            words[at] = rng.choice(base + [f"new{i}"])
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    operator = neardup.NearDuplicates(frame)
    hasher, idf = neardup.Words(operator.values), operator.idf.value
    of = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if of[a] != of[b] and (texts[a] == texts[b] or neardup.similarity(texts[a], texts[b], idf, hasher) >= neardup.THRESHOLD):
            lo, hi = sorted((of[a], of[b]))
            of = [lo if x == hi else x for x in of]
    assert {r.doc_id: r.class_id for r in operator.classes().collect()} == dict(enumerate(of))
    assert 3 < len(set(of)) < 100


def test_language(docs, none, spark):
    rows = [(i, ("der hund und die katze schlafen" if i % 2 else "the dog and the cat are sleeping") + f" x{i}", "de" if i % 2 else "en", "s") for i in range(60)]
    known = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], SCHEMA)
    model = langid.fit(known)
    out = {r.doc_id: r.lang_pred for r in model.predict(known).collect()}
    assert all(out[i] == ("de" if i % 2 else "en") for i in range(60))
    hard = {(r.doc_id, r.lang_pred, r.score) for r in model.predict(docs).collect()}
    assert (4, "und", 0.0) in hard and (3, "und", 0.0) in hard
    assert langid.fit(none).predict(none).isEmpty()
    assert langid.keep_identified(docs).columns == docs.columns


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["a", "b", "ab", "▁", "▁a"])
    import numpy as np

    p = np.array([[0.1], [0.2], [0.3], [0.25], [0.15], [1e-8]])
    want = 0.25 * 0.1 * 0.2 + 0.25 * 0.3 + 0.15 * 0.2
    assert math.isclose(math.exp(lattice.log_words(["ab"], p)[0, 0]), want)
    assert math.isclose(lattice.log_long("▁ab", p)[0], math.log(want))


def test_long_runs_are_learned_and_scored(spark):
    """Scripts without spaces: runs of any length tell two languages apart."""
    import random

    rng = random.Random(3)
    run = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([40, 90, 300])))
    rows = [(i, run("abcdefgh") if i % 2 else run("stuvwxyz"), "aa" if i % 2 else "zz") for i in range(80)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.fit(known).predict(known).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.9 for i, _, lang in rows)
    assert langid.parts_of("x" * 70) == ["▁" + "x" * 31, "x" * 32, "x" * 7]


def test_expectation_counts_all_segmentations():
    """Expected counts are those of the posterior over every segmentation, by enumeration."""
    import numpy as np

    pieces = ["a", "b", "ab", "ba", "▁", "▁a"]
    lattice, p = langid.Lattice(pieces), np.array([[0.2], [0.1], [0.3], [0.1], [0.15], [0.1], [1e-8]])
    word = "▁abab"

    def segmentations(rest):
        if not rest:
            yield []
        for n in range(1, len(rest) + 1):
            if rest[:n] in pieces:
                for tail in segmentations(rest[n:]):
                    yield [rest[:n], *tail]

    weights = [(math.prod(p[pieces.index(x), 0] for x in s), s) for s in segmentations(word)]
    want = [sum(w * s.count(x) for w, s in weights) / sum(w for w, _ in weights) * 3 for x in pieces]
    assert np.allclose(lattice.expected([word], np.array([3.0]), p)[:-1], want)


def test_language_query_learns_from_no_held_out_text(spark, tmp_path):
    """op4 on a small table: the held-out rows have other labels, which change nothing; predictions equal those of the model."""
    text = lambda i: ("der hund und die katze schlafen" if i % 2 else "the dog and the cat are sleeping") + f" x{i}"
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for name, wrong in (("a", "en"), ("b", "xx")):
        rows = [(i, text(i), wrong if held(i) else "de" if i % 2 else "en") for i in range(80)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / name / "documents.parquet"))
    one, two = ({r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.op4_language_id(spark, str(tmp_path / n)).collect()} for n in "ab")
    assert one == two and all(v[:2] == (held(i), "de" if i % 2 else "en") for i, v in one.items())


def test_sharding(docs, none):
    got = sharding.assign(docs).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [1] * 5 + [2] * 3
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(8))
    assert any(r.size == 1 and r.text_crc32 == 0 for r in got) and {r.size for r in got if r.doc_id == 0} == {len(BASE) + 1}
    assert sharding.assign(none).isEmpty()
    after, digit = sharding.curve_tables(3)

    def index(point, bits=2):
        state = h = 0
        for b in range(bits - 1, -1, -1):
            corner = sum(((x >> b) & 1) << j for j, x in enumerate(point))
            h, state = h * 8 + digit[state * 8 + corner], after[state * 8 + corner]
        return h

    path = sorted(itertools.product(range(4), repeat=3), key=index)
    assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(path))


def test_sharding_query_follows_the_curve(spark, tmp_path):
    """op8 against a plain sort of all rows by curve index and keys; files of a shard hold few values of each dimension."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    got = {(r.doc_id): r for r in sharding.op8_sharding(spark, sf).collect()}
    curve = {r.doc_id: r.curve for r in sharding.assign(docs).collect()}
    rank = lambda values: {v: i * 32 // len(values) for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v)))}
    langs, sources = rank({r.lang for r in rows}), rank({r.source for r in rows})
    after, digit = sharding.curve_tables(3)
    size = lambda r: len((r.text or "").encode()) + 1

    def index(point):
        state = h = 0
        for b in range(4, -1, -1):
            corner = sum(((x >> b) & 1) << j for j, x in enumerate(point))
            h, state = h * 8 + digit[state * 8 + corner], after[state * 8 + corner]
        return h

    want = {r.doc_id: index((langs[r.lang], sources[r.source], min(31, size(r).bit_length() - 1))) for r in rows}
    assert curve == want
    order = sorted(rows, key=lambda r: (want[r.doc_id], r.lang or "", r.source or "", zlib.crc32((r.text or "").encode()), r.doc_id))
    n = len(order)
    assert all(got[r.doc_id].shard == i * 8 // n for i, r in enumerate(order))
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert back.count() == n and set(back.columns) == {*docs.columns, "shard"}
    per = back.groupBy("shard").agg(F.countDistinct("lang").alias("langs")).collect()
    assert len(per) == 8 and sum(r.langs for r in per) < 8 * len(langs)


@pytest.mark.parametrize("clash", ["kept_key", "KEPT_ID", "mix_name", "mix_use", "lang_pred", "rank_tie"])
def test_clashing_names(spark, clash):
    rows = spark.createDataFrame([(i, f"word{i % 3} one two three four five six", "en", "s", i) for i in range(6)], f"doc_id long, text string, lang string, source string, `{clash}` long")
    for fn in (neardup.keep_one, mixing.mixed, langid.keep_identified, lambda d: decontaminate.keep_clean(d, rows.limit(0).withColumnRenamed("doc_id", "item_id"))):
        out = fn(rows)
        assert out.columns == rows.columns and out.count() >= 3


@pytest.mark.parametrize("clash", ["size", "SHARD", "slot", "law", "text_crc32", "grown_shard", "curve", "a.b", "c_0", "rank"])
def test_clashing_names_in_the_last_stages(spark, clash):
    """Names of the shards' own columns, and names with dots, pass through mixing and sharding with their values."""
    import corpus_pipeline

    rows = spark.createDataFrame([(i, f"word{i % 3} one two three", "en", "s", 10 * i) for i in range(6)], f"doc_id long, text string, lang string, source string, `{clash}` long")
    kept = corpus_pipeline.mixing(spark, rows, "")
    assert kept.columns == rows.columns and kept.count() == 6
    out = corpus_pipeline.sharding(spark, kept, "")
    assert len({c.lower() for c in out.columns}) == len(out.columns) and {"size", "shard", "slot", "law", "text"} <= set(out.columns)
    name = next(c for c in reversed(out.columns) if c.rstrip("_") == clash)
    assert {r["doc_id"]: r[name] for r in out.collect()} == {i: 10 * i for i in range(6)}


def test_mixing(docs, none):
    assert mixing.schedule(none).isEmpty() and mixing.mixed(none).isEmpty()
    uses = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert set(uses) == {r[0] for r in ROWS} and mixing.mixed(docs).columns == docs.columns
    assert uses == Counter(r.doc_id for r in mixing.schedule(docs).collect())
    totals = {"a": 1000, "b": 10}
    alpha = mixing.bisect_alpha(totals, max_repeats=3)
    assert max(mixing.repeats(totals, alpha, None).values()) <= 3 < max(mixing.repeats(totals, alpha - 2 / mixing.GRID, None).values())
    assert math.isclose(mixing.entropy(mixing.weights(totals, mixing.bisect_alpha(totals, target_entropy=0.5))), 0.5, abs_tol=1e-4)


@pytest.mark.parametrize("mark", ["TAG", "APETAGEX", "ID3", "Xing", "Info", "VBRI", "TAGAPETAGEX", "\x00TAG", "ÿû"])
def test_texts_that_look_like_tags(mark):
    """A mark at every offset and as every repetition, at the end of a payload and before it: each is read back, and the features are those of its frames."""
    coder = mpeg.Encoder()
    texts = [("x" * i + mark * n)[:700] + "y" * t for n in (1, 2, 9, 40) for t in (0, 1, 31) for i in range(0, 200, 3)] + [mark * n for n in range(1, 400)]
    for text in texts:
        n, payload = mpeg.pad(text)
        stream = coder.encode(payload)
        back, info = coder.decode(stream)
        assert back == payload and n == len(text.encode())
        room = [f[0] for f in coder.kinds]
        sizes = [room[-1]] * (len(payload) // room[-1])
        rest = len(payload) - sum(sizes)
        sizes += [next(r for r in room if r >= rest)] if rest else []
        at = stream.index(b"Xing") - 23 + len(coder.table_kind[1]) + coder.table_kind[0]
        assert info["offsets"] == [at + sum(sizes[:i]) + 23 * i for i in range(len(sizes))] and info["samples"] == 1152 * len(sizes) and info["vbr"]["frames"] == len(sizes)


def test_trailing_tags_of_files_are_read():
    """A real trailing tag lies behind the bytes that the first frame's table counts."""
    coder = mpeg.Encoder()
    stream = coder.encode(b"TAG" * 100)
    old = b"TAG" + b"A title".ljust(125, b"\0")
    ape = b"APETAGEX" + struct.pack("<III", 2000, 32, 0) + bytes(12)
    for tail in (old, ape, ape + old):
        info = mpeg.parse(stream + tail, body=True)
        assert b"".join(info["body"])[:300] == b"TAG" * 100 and info["skipped"] == 0


def test_media(docs, none):
    coder = mpeg.Encoder()
    for n in (0, 1, 64, 1417, 1418, 9000):
        payload = bytes(i * 7 % 256 for i in range(n))
        stream = coder.encode(payload)
        back, info = coder.decode(stream)
        assert back == payload and info["vbr"]["frames"] == len(info["offsets"]) and info["crc_errors"] == 0
    junk = mpeg.parse(b"junk\xff\xfb\x90" * 3 + stream[10:])
    assert junk["skipped"] > 0 and junk["samples"] == info["samples"]
    broken = bytearray(stream)
    broken[info["offsets"][0] + 8] ^= 1
    assert mpeg.parse(bytes(broken))["crc_errors"] == 1
    assert mpeg.parse(b"")["samples"] == 0 and mpeg.parse(b"\xff" * 100)["samples"] == 0
    for r in mpeg.store(docs).collect():
        text = next((t for i, t, *_ in ROWS if i == r.doc_id and len((t or "").encode()) == r.n_bytes), None)
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert mpeg.store(none).isEmpty()


def test_foreign_streams():
    """Layers I and II, MPEG 2 and 2.5, a VBRI table, and APE and ID3v1 tags at the end."""
    import struct

    def frame(version, layer, rate_index, kbits_index, mono=1):
        bits = {1: 3, 2: 2, 2.5: 0}[version]
        head = bytes([0xFF, 0xE0 | bits << 3 | (4 - layer) << 1 | 1, kbits_index << 4 | rate_index << 2, (3 if mono else 0) << 6])
        size = mpeg.header(head + bytes(4), 0)[3]
        return head + bytes(size - 4)

    for version, layer, rate, samples in ((1, 1, 44100, 384), (1, 2, 44100, 1152), (2, 1, 22050, 384), (2, 2, 22050, 1152), (2, 3, 22050, 576), (2.5, 3, 11025, 576)):
        one = frame(version, layer, 0, 5)
        id3v1 = b"TAG" + b"Song".ljust(125, b"\0")
        ape = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8)
        found = mpeg.parse(one * 7 + ape + id3v1)
        assert (found["samples"], found["rate"], found["offsets"], found["skipped"]) == (7 * samples, rate, [i * len(one) for i in range(7)], 0)
        assert found["tags"] == {"TIT2": "Song"}
    first = bytearray(frame(1, 3, 0, 9))
    first[36:62] = b"VBRI" + struct.pack(">HHHII", 1, 0, 0, 4321, 3) + bytes(8)
    found = mpeg.parse(bytes(first) + frame(1, 3, 0, 9) * 3)
    assert found["vbr"] == {"kind": "VBRI", "frames": 3, "bytes": 4321} and len(found["offsets"]) == 3


def test_described_files(spark):
    stream = mpeg.Encoder().encode(bytes(5000))
    row = mpeg.describe(spark.createDataFrame([("a", bytearray(stream)), ("b", None)], "path string, content binary")).where("path = 'a'").first()
    assert row.n_frames == len(row.frame_offsets) > 0 and row.n_samples == 1152 * row.n_frames


def test_positives_are_bounded_by_rows(spark, monkeypatch):
    """A trusted id on any number of texts: what reaches the driver follows the bound on positives, and equal rows count once."""
    import zlib

    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([(one, f"Text {i} of the same id.") for i in range(600)] + [(one, "Again.")] * 900 + [(1000 + i, f"Other {i}.") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 1)], "doc_id long, quality int")
    sizes = []
    real = quality.measured
    monkeypatch.setattr(quality, "measured", lambda rows: sizes.append(len(got := real(rows))) or got)
    assert quality.fit(docs, labels, positives=20, unlabelled=200) is not None
    assert 10 <= sizes[0] <= 80
    sizes.clear()
    quality.fit(docs, labels, positives=1000, unlabelled=200)
    assert sizes[0] == 601


def test_pages(spark):
    page = "<html><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy this now, it is cheap and very good for you.</div><article><h1>Head &amp; line</h1><p>First\n part <b>bold</b>.<br><p>Short.</p><section id=comments><p>Nice post!</p></section></article><footer>&copy; us</footer>"
    assert mainpage.main_text(page) == "Head & line\nFirst part bold.\nShort."
    plain = "<div><a href=1>a</a> <a href=2>b</a></div><div>A long enough paragraph of running text stands here.</div><div>And a second one follows it at once.</div><form>Search</form>"
    assert mainpage.main_text(plain) == "A long enough paragraph of running text stands here.\nAnd a second one follows it at once."
    rows = spark.createDataFrame([(1, None, None), (1, "u", ""), (2, "u", "<p"), (3, "u", "<!-- x"), (4, "u", "<script>x")], "page_id long, url string, html string")
    assert {r.text for r in mainpage.extract(rows).collect()} == {""}
    assert mainpage.extract(rows.limit(0)).isEmpty()


def test_windows_equal_brute_force():
    """Runs are the maximal stretches of windows with weight that reach the surge, whatever the two parameters."""
    import random

    rng = random.Random(4)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 5, 30, 80]) for _ in range(rng.randint(0, 25))]
        window, surge = rng.choice([1, 2, 3, 5]), rng.choice([1, 20, 60])
        sums = [sum(weights[i : i + window]) for i in range(len(weights))]
        want = []
        for a, b in itertools.combinations(range(len(weights) + 1), 2):
            whole = all(sums[a:b]) and (a == 0 or not sums[a - 1]) and (b == len(weights) or not sums[b])
            if whole and max(sums[a:b]) >= surge:
                lines = [i for i in range(a, min(len(weights), b + window - 1)) if weights[i] and i < b]
                want.append((lines[0], lines[-1] + 1, sum(weights[lines[0] : lines[-1] + 1])))
        assert mainpage.surges(weights, window, surge) == want


def test_the_mark_is_a_weight(monkeypatch):
    """Runs decide between marked and unmarked text; links among the lines of an article are no dive."""
    links = "<ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(4)) + "</ul>"
    page = f"<article><p>A sentence of the article.</p>{links}<p>Two.</p></article>"
    whole = "A sentence of the article.\nLink 0\nLink 1\nLink 2\nLink 3\nTwo."
    long = "<div>" + "".join(f"<p>Paragraph {i} of a long text that no element marks, which says something.</p>" for i in range(20)) + "</div>"
    assert mainpage.main_text(page) == mainpage.main_text(page + long[: long.index("Paragraph 2")] + "</div>") == whole
    told = mainpage.main_text(page + long).split("\n")
    assert len(told) == 20 and told[0].startswith("Paragraph 0") and told[-1].startswith("Paragraph 19")
    assert mainpage.main_text(f"<article>{links}</article>{long}").split("\n") == told
    assert mainpage.main_text(f"<article>{links}</article><p>Short.</p>") == "\n".join(f"Link {i}" for i in range(4))
    monkeypatch.setattr(mainpage, "SURGE", 5000)
    assert mainpage.main_text(page + long) == whole
    monkeypatch.setattr(mainpage, "SURGE", 40)
    monkeypatch.setattr(mainpage, "MARKED", 1000)
    assert mainpage.main_text(page + long) == whole


def test_layout_classes_do_not_decide():
    """A wrapper that is content as well, and an article inside a layout element, keep their text; comments and adverts go."""
    body = "<p>A paragraph of the article that says something of its own.</p><p>And another one which goes on about it.</p>"
    text = "A paragraph of the article that says something of its own.\nAnd another one which goes on about it."
    assert mainpage.main_text(f'<div class="content widget-area">{body}</div>') == text
    assert mainpage.main_text(f'<div class="widget-area"><article>{body}<div class="widget">Other things.</div></article></div>') == text
    assert mainpage.main_text(f'<main>{body}<div class="post-comments content"><article class=comment><p>I do not agree.</p></article></div></main>') == text
    assert mainpage.main_text(f'<div>{body}</div><div class="related-content"><p>Something else that is long enough to be a text.</p></div>') == text


@pytest.mark.parametrize("page", ["<b>x" * 20_000 + "</i>" * 20_000, "<b>" * 40_000 + "<hr>x" * 20_000, "<p><b>x</i>" * 15_000, "<a " * 50_000, "<div>" * 30_000 + "x", '<a "' * 40_000, "<!-- " * 30_000])
def test_nested_pages_take_linear_time(page):
    import time

    began = time.process_time()
    mainpage.main_text(page)
    assert time.process_time() - began < 2


def test_page_query_equals_a_direct_parse(spark):
    """op6 over the given pages: headings and paragraphs of <article>, which hold nothing else, cut out by their tags."""
    import html

    sf, n = "/root/testdata/sf0.001", 0
    got = {r.page_id: r for r in mainpage.op6_html(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1)>", inside)]
        want = "\n".join(x for x in blocks if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
        n += len(want)
    assert len(got) == 50 and n > 10_000


def test_links_inside_a_marked_article_stay():
    """Nothing inside a marked article is a dive: lists of links stay wherever they stand, and an article of links alone too."""
    links = lambda n: "<ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(n)) + "</ul>"
    body = "<article><h1><a href=x>Title</a></h1><p>One.</p>{}<p>Two.</p>{}</article>"
    said = lambda n: [f"Link {i}" for i in range(n)]
    for a, b in ((4, 3), (2, 1), (0, 0)):
        assert mainpage.main_text(body.format(links(a), links(b))) == "\n".join(["Title", "One.", *said(a), "Two.", *said(b)])
    assert mainpage.main_text(f"<main>{links(3)}</main>") == "Link 0\nLink 1\nLink 2"


def test_unmarked_articles_stay_whole():
    """Dropped blocks, lists of links and shortness take no paragraph of an article that no element marks."""
    said = [f"Paragraph {i} of the article says something of its own." for i in range(6)]
    paragraphs = lambda a, b: "".join(f"<p>{t}</p>" for t in said[a:b])
    related = "<ul{}>" + "".join(f"<li><a href={i}>Elsewhere {i}</a></li>" for i in range(3)) + "</ul>"
    other = "<div><p>Another block beyond it which has a text as long as this.</p></div>"
    for between in (related.format(" class=related"), related.format(""), "<div class=ad><p>Buy.</p><p>Now.</p><p>It is cheap and good.</p></div>"):
        page = f"<body><div>{related.format('')}</div><div>{paragraphs(0, 2)}{between}<p>Short.</p>{between}{paragraphs(2, 6)}</div><div>{related.format('')}</div>{other}</body>"
        assert mainpage.main_text(page) == "\n".join([*said[:2], "Short.", *said[2:]])
    assert mainpage.main_text("<body><nav><a href=x>Home</a></nav><p>Back soon.</p></body>") == "Back soon."


def test_substrings(spark, none):
    passage = " ".join(f"Word{i} goes here and there again." for i in range(12))
    rows = [(3, f"Own start one.\n{passage}\nOwn end three."), (1, f"Else entirely.\n{passage}"), (2, None), (4, ""), (5, "A. B. C."), (6, "A. B. C."), (1, f"Else entirely.\n{passage}")]
    got = [(r.doc_id, r.text) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (3, "Own start one.\nOwn end three.") in got and (1, rows[1][1]) in got and (1, "") in got
    assert (2, None) in got and (5, "A. B. C.") in got and (6, "A. B. C.") in got
    assert substrings.remove_repeats(none).isEmpty()


def test_substring_query_equals_brute_force(spark):
    """op5 against every run of every text in order: a unit goes if a run that covers it was there before."""
    import pyarrow as pa

    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    seen, want = set(), {}
    for r in rows:
        units = substrings.Units()
        units(pa.array([r.text], pa.string()))
        hashes, _, at = units.runs()
        gone = set()
        mark = (1 << substrings.SPAN_BITS) - 1
        for h, x in sorted(zip(hashes.tolist(), at.tolist(), strict=True), key=lambda p: p[1]):
            if h in seen:
                gone |= set(range(x >> substrings.SPAN_BITS, (x >> substrings.SPAN_BITS) + (x & mark)))
            seen.add(h)
        want[r.doc_id] = (int(units.row_counts[0]), len(gone))
    got = {r.doc_id: (r.n_units, r.n_removed) for r in substrings.op5_substring_dedup(spark, sf).collect()}
    assert got == want and sum(n for _, n in want.values()) > 0


def removed_of(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in substrings.remove_repeats(frame).collect()}


def test_repeats_of_short_sentences_are_removed(spark):
    """A passage of one-word sentences goes wholly, though three of them are under MIN_CHARS."""
    passage = " ".join(f"Q{i}x!!" for i in range(50))
    got = removed_of(spark, f"Begin with own words here.\n{passage}\nAnd own end.", f"Other lead in.\n{passage}\nOther end.")
    assert got[1] == "Other lead in.\nOther end."


def test_repeats_behind_other_lead_ins_are_removed(spark):
    """51 words repeated inside a long sentence lose all but a window at each end, wherever they stand."""
    passage = [f"p{i * 7919 % 1009}" for i in range(51)]
    texts = [" ".join([f"a{n}x{i}" for i in range(n)] + passage + [f"z{n}x{i}" for i in range(20)]) for n in range(24)]
    got = removed_of(spark, *texts)
    assert got[0] == texts[0]
    for n in range(1, 24):
        left = got[n].split()
        assert sum(w in passage for w in left) <= 2 * substrings.WINDOW and {w for w in texts[n].split() if w not in passage} <= set(left)


def test_quality(spark, docs, none):
    good = [(i, f"The plain sentence number {i} reads well and ends here. " * 3) for i in range(200)]
    bad = [(i + 200, f"zz### {i}%%% qq!!! ZZZ!! $$$ " * 12) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(table, quality.fit(table, labels)).collect()}
    assert sum(scores[i] >= 0.3 for i, _ in good) >= 195 and sum(scores[i] < 0.3 for i, _ in bad) >= 55
    model = quality.fit(table, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect()) and quality.score(none, model).isEmpty()
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_quality_query_learns_from_no_held_out_label(spark, tmp_path):
    """op3 on a small table: labels of held-out rows change nothing, and held-out texts are told apart."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    good = [(i, f"The plain sentence number {i} reads well and ends here. " * 3, 1) for i in range(200)]
    bad = [(i + 200, f"zz### {i}%%% qq!!! ZZZ!! $$$ " * 12, 0) for i in range(60)]
    for name, flip in (("a", 0), ("b", 1)):
        at = str(tmp_path / name)
        spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, _, q in good + bad], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    one, two = ({r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.op3_quality(spark, str(tmp_path / n)).collect()} for n in "ab")
    assert one == two and all(v[0] == held(i) and v[2] == (v[1] >= 0.3) for i, v in one.items())
    assert sum(one[i][2] == q for i, _, q in good + bad if held(i)) >= 0.9 * sum(held(i) for i, *_ in good + bad)


def test_risk_and_prior():
    """The estimated prior is near the true share, and the risk's minimum tells the classes apart without any negative label."""
    import numpy as np

    rng = np.random.default_rng(2)
    draw = lambda n, mean: np.append(rng.normal(mean, 1, (n, 3)), np.ones((n, 1)), axis=1)
    positive, unlabelled, truth = draw(2000, 1.2), np.concatenate([draw(1200, 1.2), draw(2800, -1.2)]), np.arange(4000) < 1200
    first = quality.minimise(positive[:1000], unlabelled, 0.5)
    prior = quality.estimate_prior(positive[1000:] @ first, unlabelled @ first)
    assert abs(prior - 0.3) < 0.1
    assert ((unlabelled @ quality.minimise(positive, unlabelled, prior) > 0) == truth).mean() > 0.9


def test_lm(docs, none):
    got = maxent.score(docs).collect()
    words = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]
    counts = Counter(w for i, t, *_ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in ROWS:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))
        assert any(r.doc_id == i and r.n_tokens == len(words(t)) and r.train_tokens == n and math.isclose(r.base_score, base, rel_tol=1e-9) for r in got)
    assert len(got) == len(ROWS) and maxent.score(none).isEmpty()


def test_lm_learns_from_every_position(spark, monkeypatch):
    """Each pass sees each training token once, as many as are counted, in short documents too."""
    rows = spark.createDataFrame([(i, f"ab{i} cd ef") for i in range(40)], "doc_id long, text string").coalesce(1)
    seen, totals = [], maxent.sum_vectors
    monkeypatch.setattr(maxent, "sum_vectors", lambda *a, **k: seen.append(got := totals(*a, **k)) or got)
    tokens = maxent.score(rows).first().train_tokens
    assert tokens == 4 * sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(40))
    assert [seen[0].sum(), seen[1].sum()] == [tokens, maxent.TABLES * tokens] and [v[-1] for v in seen[2:]] == [tokens] * maxent.EPOCHS


def test_lm_scores_do_not_depend_on_the_layout(spark):
    """Any dealing of the rows to files gives the same scores, and held-out texts gain on their base."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [{r.doc_id: (r.score, r.base_score, r.held_out) for r in maxent.score(docs.repartition(n)).collect()} for n in (1, 7, 30)]
    assert all(math.isclose(got[0][i][0], other[i][0], rel_tol=1e-9) for other in got[1:] for i in got[0])
    held = [(s, b) for s, b, h in got[0].values() if h]
    assert sum(s for s, _ in held) > sum(b for _, b in held)


def test_lm_descent_lowers_the_loss():
    """Gradient steps from the closed-form start approach a known conditional distribution."""
    import numpy as np

    rng, rows, n = np.random.default_rng(1), maxent.SMALLEST, 40_000
    last = rng.integers(0, 4, n)
    truth = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.25] * 4, [0.05, 0.05, 0.1, 0.8]])
    classes = np.array([rng.choice(4, p=truth[x]) for x in last])
    features = np.stack([last + j * rows for j in range(maxent.TABLES)], 1).astype(np.int32)
    weights, squares = np.zeros((maxent.TABLES * rows + 1, 4), np.float32), np.zeros((maxent.TABLES * rows + 1, 4), np.float32)
    loss = lambda: -maxent.log_softmax(weights, features)[np.arange(n), classes].mean()
    before = loss()
    for i in range(0, n, 2000):
        maxent.descend(weights, classes[i : i + 2000], features[i : i + 2000], squares, maxent.RATE)
    best = -sum((last == x).mean() * (truth[x] * np.log(truth[x])).sum() for x in range(4))
    assert loss() < before and loss() - best < 0.02


def test_pipeline(spark, tmp_path):
    """Each stage on all that its predecessor kept, against plain Python over the same rows."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {"start": spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, docs, sf)
        assert out.columns == docs.columns or name == "sharding"
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    start, language, near, clean, mixed, shards = kept.values()
    ids = lambda rows: {r.doc_id for r in rows}
    assert ids(language) >= {r.doc_id for r in start if r.lang and len(re.findall(r"[^\W\d_]+", r.text or "")) >= 20}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in language for w in [words(r.text)]}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert len({r.text for r in near}) == len(near)
    assert not any(alike(a, b) >= 0.9 for a, b in itertools.combinations(sorted(ids(near)), 2))
    assert all(any(alike(i, j) >= 0.8 for j in ids(language) - {i}) for i in ids(language) - ids(near))
    runs = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        runs |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in runs}
    hit = {r.doc_id for r in near if any(tuple(words(r.text)[i : i + n]) in runs for n in sizes for i in range(len(words(r.text)) - n + 1))}
    assert ids(clean) == ids(near) - hit
    assert ids(mixed) == ids(clean) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    key = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)
    assert Counter(map(key, shards)) == Counter(map(key, mixed))
    per = Counter(r.shard for r in shards)
    assert sorted(per) == list(range(8)) and max(per.values()) - min(per.values()) <= 1


def test_merged_components(spark):
    """Adding links step by step gives the components of all links, ones between new nodes included."""
    known, new = [(1, 2), (2, 3), (5, 6), (8, 9), (20, 21)], [(3, 5), (9, 10), (11, 12), (6, 1), (30, 20)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a int, b int")
    for first in (known, []):
        got = graph.merged(graph.components(frame(first)), frame(new))
        want = graph.components(frame(first + new))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["node"]: r["label"] for r in graph.merged(graph.components(frame(known)), frame(new)).collect()}[6] == 1
