"""Edge tables of the operators, models of the folds, and the catalogue against DuckDB."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rubrica.config import EngineConfig, effective_limit
from rubrica.functions import normalize, scalars
from rubrica.operators import duplicates, judge, levels, mapping, quota, rules, score
from rubrica.plans import bind, pipeline, staging
from rubrica.plans.staging import numbered, stage
from verify import compare, connect

SF = "/root/testdata/sf0.001"


def column(spark, values, kind, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


# --- values, levels, mapping ---


def test_strip_and_numbers(spark):
    assert column(spark, ["\t x \n", " y ", "", None], "string", normalize.strip) == ["x", "y", "", None]
    assert column(spark, [" 22 ", "22.0", "+5", "", "1e3", None], "string", normalize.whole) == [22, None, 5, None, None, None]
    assert column(spark, ["1e3", "1d", "1f", "inf", "x", None], "string", normalize.number) == [1000.0, None, None, float("inf"), None, None]


def test_levels(spark):
    hours = [1.99, 2.0, 4.0, 4.5, 5.0, 8.0, 8.5, 9.0, 18.0, 18.5, 19.0, float("inf"), float("nan"), -3.0, None]
    assert column(spark, hours, "double", levels.level_of) == [None, 1, 1, None, 2, 2, None, 3, 3, None, 4, 4, None, None, None]
    assert column(spark, hours, "double", lambda h: levels.level_by_type(F.lit("Workshop"), h)) == [None] * 4 + [2, 2, None, 3, 3, None, 4, 4, None, None, None]


def test_durations(spark):
    texts = ["3.0h", "-3.0h", "180 minutes", "2h 30m", "1e+16h", "nanh", "", None]
    assert column(spark, texts, "string", levels.parse_hours) == [3.0, 3.0, 180.0, 2.0, 1.0, None, None, None]
    shown = lambda v: mapping.duration_text(v, F.lit(""))
    assert column(spark, [3.0, 1e7, 1e16, 0.5, 1e-5, float("nan"), float("inf")], "double", shown) == ["3.0h", "10000000.0h", "1e+16h", "0.5h", "1e-05h", "nanh", "infh"]


def test_academic_year(spark):
    years = ["2024-25", "2024-2025", "2024", "202425", "1999", "2024-5", "24-25", "abcd", "24", " 2024-25 ", None]
    want = ["2024-25", "2024-25", "2024-25", "2024-25", "1999-00", "", "24-25", "", "24", "2024-25", ""]
    assert column(spark, years, "string", mapping.academic_year) == want


def test_paths(spark):
    base = "https://storage.example.org/container"
    got = column(spark, ["", "https://h/x", "http://h/x", " /a/b.pdf "], "string", lambda v: mapping.resolve_path(v, F.lit(3)))
    assert got == [None, "https://h/x", f"{base}/uploads/institutes/http://h/x", f"{base}/uploads/institutes/a/b.pdf"]
    assert column(spark, ["a,b;c", "a;b", "0, N/A ,x", ""], "string", mapping.split_paths) == [["a", "b;c"], ["a", "b"], ["x"], []]
    assert column(spark, [" N/A ", "None", "p.jpg"], "string", lambda v: mapping.image_paths([v], F.lit(1))) == ["", "", f"{base}/p.jpg"]


def mapped_one(spark, origin, schema, *values):
    return mapping.mapped(spark.createDataFrame([values], schema), origin=origin).first()


def test_mapping_takes_any_columns(spark):
    """Absent columns, nulls of both origins, and numbers or texts in any column."""
    bare = mapped_one(spark, "file", "other int", 1)
    assert (bare.sid, bare.m_title, bare.m_year_type, bare.m_duration, bare.m_participants, bare.m_level, bare.driven, bare.canonical) == ("unknown", "", "Financial", "", 0, None, None, False)
    assert bare.m_pdf_path == "" and bare.m_image_paths == "" and bare.broken is None and bare.directory == "None_None"
    schema = "eventId string, activity_name string, activity_duration double, student_participants int, faculty_participants string, acadmic_year int, financial_year string, event_driven double, report string, photo1 string, photo2 string"
    null = (None,) * 11
    file, json = mapped_one(spark, "file", schema, *null), mapped_one(spark, "json", schema, *null)
    assert (file.sid, file.m_title, file.m_duration, file.m_participants, file.m_year) == ("nan", "nan", "nanh", 0, "nan")
    assert (json.sid, json.m_title, json.m_duration, json.m_participants, json.m_year) == ("None", "None", "", 0, "")
    assert file.m_image_paths.endswith("/nan") and json.m_image_paths == "" and "'float'" in file.broken and "'NoneType'" in json.broken
    full = mapped_one(spark, "file", schema, "e7", " A ", 3.0, 20, "", 2024, "2024-25", 2.0, "/r.pdf", "0", "p.jpg")
    assert (full.sid, full.m_title, full.m_duration, full.m_level, full.m_participants, full.m_year, full.driven, full.canonical, full.directory) == ("e7", "A", "3.0h", 1, 20, "2024-25", 2, True, "2.0_2024")
    text = mapped_one(spark, "json", "id int, activity_duration string, student_participants string, faculty_participants double, event_driven string", 5, "two", " 15 ", 7.9, "2")
    assert (text.sid, text.m_duration, text.m_participants, text.driven, text.canonical) == ("5", "two", 22, 2, False)
    pair = lambda a, b, kind="string": mapped_one(spark, "json", f"student_participants {kind}, faculty_participants {kind}", a, b).m_participants
    assert [pair("22", "22"), pair("", "20"), pair("22.0", "1"), pair("16", None), pair(22.9, 0.0, "double"), pair(float("nan"), 20.0, "double")] == [44, 20, 0, 16, 22, 0]


def test_titles(spark):
    kinds = ["Level 1 - Expert Talk", "Workshop", "", "Level1 - Expert Talk", "Level", "Level 2 Level 3 - X"]
    got = column(spark, kinds, "string", lambda v: scalars.canonical_title(v, F.lit("T")))
    assert got == ["Level 1 - Expert Talk - on T", "Workshop - on T", " - on T", "Level 1 - Expert Talk - on T", "Level - on T", "Level 2 - X - on T"]


def test_names(spark):
    """Python's word boundary and white space, which take letters beyond ASCII for letters."""
    import re

    texts = ["Thshea Stteä", "éDr Who", "Professor Smith", "Miss Jane", "dr jane", "ÄB Cd", "x_Jane Doe", "A1 Bc", "Jane Doe", "", "Mr.Smith", "Prof. Smith"]
    want = [any(re.search(p, t) is not None for p in scalars.NAME_PATTERNS) for t in texts]
    assert column(spark, texts, "string", scalars.has_name) == want


def test_names_of_files(spark):
    assert column(spark, ["https://h/a/b.pdf?x=1", "https://h"], "string", scalars.download_name)[0] == "b.pdf"
    assert len(column(spark, ["https://h"], "string", scalars.download_name)[0]) == 8


# --- rules and the judge ---


def test_level_rule(spark):
    rows = [("3.0h", "1"), ("4.5h", None), ("0.0h", None), ("-3.0h", None), ("180 minutes", None), ("nanh", None), ("infh", "4"), ("3.0h", "2"), ("3.0h", "x"), ("3.0h", "9"), ("4.5h", "4")]
    df = spark.createDataFrame(rows, "d string, l string").withColumn("h", levels.parse_hours(F.col("d"))).withColumn("r", rules.level_rule(F.col("d"), F.col("h"), F.col("l")))
    got = [(r["r"]["passed"], r["r"]["message"]) for r in df.collect()]
    assert [p for p, _ in got] == [True, False, False, True, True, False, False, True, False, False, False]
    assert got[7][1] == "Level auto-corrected from 2 to 1 based on duration 3.0h" and got[9][1] == "Invalid level: 9. Valid levels are 1-4." and got[10][1].endswith("requirements (19+ hours)")


def model_verdict(answer, keys):
    """Line by line, as the protocol says."""
    out = {n: "" if n == "reasoning" else 0 if n == "participant_count" else False for n in keys.values()}
    for line in (answer or "").split("\n"):
        line = line.strip()
        key = next((k for k in keys if k in line), None)
        if key == "REASONING:":
            out["reasoning"] = line.split(":", 1)[1].strip()
        elif key == "PARTICIPANT_COUNT:":
            try:
                out["participant_count"] = int(line.split(":")[1].strip())
            except ValueError:
                pass
        elif key:
            out[keys[key]] = "YES" in line.upper()
    return out


@pytest.mark.parametrize("keys", [judge.PDF_KEYS, judge.IMAGE_KEYS, judge.REVIEW_KEYS, judge.CONSISTENCY_KEYS])
def test_parser_equals_its_model(spark, keys):
    rng, names = random.Random(3), list(keys)
    values = [" YES", " no", " NO (not YES)", "", " 7", " ~20", " 12: 3", ": : 4 :", " yes and REASONING: YES", "\tx\r"]
    texts = ["\n".join(rng.choice(["", "x ", "  "]) + rng.choice([*names, "OTHER:"]) + rng.choice(values) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    got = column(spark, [*texts, None], "string", lambda v: judge.verdict(v, keys))
    assert [r.asDict() for r in got] == [model_verdict(t, keys) for t in [*texts, None]]


def test_hamming_and_delays(spark):
    assert column(spark, ["ab12", "abz3", "abc"], "string", lambda v: scalars.hamming(v, F.lit("ab12"))) == [0, 2, None]
    a = "0123456789abcdef"
    assert column(spark, [a, "f" + a[1:], a[::-1], a.upper()], "string", lambda v: scalars.hamming(v, F.lit(a))) == [0, 1, 16, 6]
    assert column(spark, ["retry in 49.42s", "retry in 1s", "quota", "x"], "string", lambda v: scalars.backoff(v, F.lit(2))) == [49.42, 5.0, 8.0, 1.0]
    assert column(spark, ["rate limit: try again in 2s"], "string", lambda v: scalars.backoff(v, F.lit(0), True)) == [2.5]
    assert judge.wait_after("retry in 1s", 2) == 5.0 and judge.wait_after("quota", 2) == 8.0 and judge.wait_after("429 try again in 2s", 0, True) == 2.5 and judge.wait_after("x", 1) == 1.0


def test_score_of_any_text(spark):
    assert column(spark, ["nan", "1e12", "x", "", "59.9", "-3", None], "string", score.coerced) == [0, 0, 0, 0, 59, -3, 0]


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def client(provider, clock, **how):
    return judge.Client(provider, clock=clock, sleep=clock.sleep, **how)


def test_client_retries_then_falls_back():
    clock, said = Clock(), []

    def broken(prompt, image):
        said.append(prompt)
        raise RuntimeError("429 quota, retry in 6s")

    second = client(lambda p, i: " Yes \n", clock, is_fallback=True)
    first = client(broken, clock, fallback=second)
    assert first.ask("p") == "Yes" and len(said) == 3 and clock.now >= 1018
    assert first.ask("q", b"image") == "Yes" and len(said) == 6  # asked without the image
    assert client(broken, clock).ask("p") is None
    known = client(lambda p, i: said.append(p) or "NO", clock)
    before = len(said)
    assert known.ask("same") == known.ask("same") == "NO" and len(said) == before + 1


def test_open_breaker_sends_calls_to_the_fallback():
    clock, said = Clock(), []

    def broken(prompt, image):
        said.append(prompt)
        raise RuntimeError("rate limit")

    config = EngineConfig(breaker_min_errors=2, breaker_min_requests=2, breaker_cooldown_s=1e6, breaker_window_s=1e6)
    first = client(broken, clock, fallback=client(lambda p, i: "YES", clock, is_fallback=True), config=config)
    assert first.ask("a") == "YES" and len(said) == 2
    assert first.ask("b") == "YES" and len(said) == 2


def test_judge_asks_once_and_survives_failures(spark, tmp_path):
    log = str(tmp_path / "asked")

    def ask(prompt, image):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise ValueError("broken")
        return "YES"

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "", None, "bad", "a"])], "judge_key int, p string")
    quick = EngineConfig(attempts=1, rpm=10**9, max_concurrent=2)
    cache = str(tmp_path / "cache")
    out = judge.judged(rows, "p", ask, config=quick, cache=cache)
    for _ in range(2):
        assert [r.answer for r in out.orderBy("judge_key").collect()] == ["YES", "YES", "YES", None, None, None, "YES"]
    assert sorted(open(log).read().split()) == ["a", "b", "bad"] and out.columns == ["judge_key", "p", "answer"]
    again = judge.judged(rows, "p", ask, config=quick, cache=cache)
    assert [r.answer for r in again.orderBy("judge_key").collect()] == ["YES", "YES", "YES", None, None, None, "YES"]
    assert sorted(open(log).read().split()) == ["a", "b", "bad", "bad"]


def test_race_takes_the_first_answer():
    """Both sides are under way; the slow one is not waited for, and makes no further attempt."""
    import threading

    release, tried = threading.Event(), []

    def slow(prompt, image):
        tried.append(prompt)
        if len(tried) == 1:
            raise RuntimeError("first failure")
        release.wait(20)
        raise RuntimeError("too late")

    clock, config = Clock(), EngineConfig(attempts=1)
    started = threading.Event()

    def fast(prompt, image):
        if not started.is_set():  # the chain's own fallback fails, too
            started.set()
            raise RuntimeError("not yet")
        return "Yes, it fits"

    first = client(slow, clock, fallback=client(fast, clock, is_fallback=True, config=config), config=replace(config, attempts=1))
    assert first.race("p") == "Yes, it fits" and len(tried) <= 2 and not release.is_set()
    release.set()
    assert first.race("p") == "Yes, it fits" and len(tried) <= 2  # known now
    nobody = client(slow, clock, fallback=client(slow, clock, is_fallback=True, config=config), config=config)
    assert nobody.race("q") is None
    assert client(lambda p, i: " NO ", clock).race("r") == "NO" and client(lambda p, i: "", clock).race("s") is None


def test_local_providers_are_not_paused():
    clock = Clock()
    quick = client(judge.stub_judge, clock)
    assert {quick.ask(f"p{i}") for i in range(50)} == {"YES", "NO"} and clock.now == 1000.0
    paced = client(lambda p, i: "YES", clock)
    paced.ask("a"), paced.ask("b")
    assert clock.now > 1000.0


def test_cache_reads_its_buckets_only(spark, tmp_path):
    cache = judge.AnswerCache(spark, str(tmp_path / "cache"))
    keys = spark.range(600).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.concat(F.lit("a"), F.col("id")).alias("answer"))
    assert cache.known(keys).isEmpty()
    cache.add(keys.where("answer <= 'a3'"))
    cache.add(keys.where("answer > 'a2'"))
    one = keys.where("answer = 'a7'")
    plan = cache.known(one)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert [r.answer for r in cache.known(one).collect()] == ["a7"]
    want = {r.key: r.answer for r in keys.collect()}
    for _ in range(2):
        assert {r.key: r.answer for r in cache.known(keys).collect()} == want
        cache.compact()
        assert len(cache.parts()) == 1


def test_appends_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    cache = judge.AnswerCache(spark, str(tmp_path / "cache"))
    part = lambda i: spark.range(40 * i, 40 * i + 40).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(f"part {i}").alias("answer"))
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda i: cache.compact() if i == 3 else cache.add(part(i)), range(6)))
    got = cache.rows().groupBy("answer").count().collect()
    assert {r.answer: r["count"] for r in got} == {f"part {i}": 40 for i in (0, 1, 2, 4, 5)}


def test_pictures_join_the_prompts_that_show_them(spark):
    rows = spark.createDataFrame([(i, "look" if i != 3 else None, p) for i, p in enumerate(["a", "b", "copy of a", "a", "gone", None])], "i int, p string, shown string")
    pictures = spark.createDataFrame([("a", "x", bytearray(b"1")), ("b", "y", bytearray(b"2")), ("copy of a", "x", bytearray(b"1"))], "path string, sha256 string, content binary")
    tell = lambda prompt, image: f"{prompt} {image}"
    tell.local = True
    out = judge.judged(rows, "p", tell, image="shown", pictures=pictures, config=EngineConfig(max_concurrent=2))
    assert out.columns == ["i", "p", "shown", "answer"]
    assert {r.i: r.answer for r in out.collect()} == {0: "look b'1'", 1: "look b'2'", 2: "look b'1'", 3: None, 4: "look None", 5: "look None"}


# --- duplicates ---


def scan(rows, threshold):
    """The sequential scan: {submission: messages} of rows (submission, pos, key, sha, hash, path) in order."""
    seen, cached, out = {}, {}, {}
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99
    for s, _, key, sha, h, path in rows:
        said = out.setdefault(s, [])
        if sha is None:
            continue
        if sha in seen:
            said.append(f"Image identical to submission {seen[sha][0]} (SHA256 match)")
            continue
        near = next(((p, apart(h, g)) for g, p in cached.get(key, {}).values() if h and g and apart(h, g) <= threshold), None)
        if near:
            said.append(f"Image similar to file in directory (pHash match (similarity score: {near[1]:.1f})): {near[0]}")
        other = next(((who, apart(h, g)) for who, g in seen.values() if h and g and g != h and apart(h, g) <= threshold), None)
        if other:
            said.append(f"Image similar to submission {other[0]} (pHash distance: {other[1]}, threshold: {threshold})")
        if not said:
            seen[sha] = (s, h)
            cached.setdefault(key, {})[sha] = (h, path)
    return {s: m for s, m in out.items() if m}


def photo_rows(rng, n, alphabet, contents):
    rows = []
    for s in range(n):
        for pos in range(rng.choice([0, 1, 2, 2, 3])):
            sha = None if rng.random() < 0.05 else f"s{rng.randrange(contents)}"
            h = None if sha is None or hash(sha) % 11 == 0 else "".join(random.Random(sha).choice(alphabet) for _ in range(16))
            rows.append((s, pos, rng.choice("kl"), sha, h, f"p{s}.{pos}"))
    return rows


@pytest.mark.parametrize("seed,n,alphabet,contents,threshold", [(1, 60, "ab", 40, 5), (2, 120, "abc", 25, 5), (3, 50, "ab", 400, 3), (4, 40, "abcdef0123", 15, 0), (5, 30, "ab", 30, 11)])
def test_greedy_duplicates_equal_the_scan(spark, seed, n, alphabet, contents, threshold):
    rows = photo_rows(random.Random(seed), n, alphabet, contents)
    schema = "submission long, ord long, pos int, key string, sha256 string, phash string, path string"
    df = spark.createDataFrame([(s, s, pos, k, sha, h, p) for s, pos, k, sha, h, p in rows], schema)
    want = scan(rows, threshold)
    ways = [{}, {"fold_rows": 0}, {"fold_rows": 6, "local_edges": 20}] if seed < 3 else [{}]  # by scans of components, in rounds, by both with contracted edges
    for how in ways:
        assert {r["submission"]: r["messages"] for r in duplicates.greedy_messages(df, threshold, **how).collect()} == want
    if seed == 1:
        assert {r["submission"]: r["flagged"] for r in duplicates.greedy(df, threshold).collect()} == {r[0]: r[0] in want for r in rows}


@pytest.mark.parametrize("seed,n,alphabet,contents,threshold,block", [(1, 60, "ab", 40, 5, 7), (2, 60, "abc", 25, 5, 10**6), (3, 60, "ab", 400, 3, 1), (4, 60, "0123456789abcdef", 300, 11, 20), (6, 40, "abZ", 60, 5, 9)])
def test_crowded_duplicates_equal_the_scan(spark, seed, n, alphabet, contents, threshold, block):
    """By blocks: each block's remembered photos settle the photos behind it."""
    rows = photo_rows(random.Random(seed), n, alphabet, contents)
    schema = "submission long, ord long, pos int, key string, sha256 string, phash string, path string"
    df = spark.createDataFrame([(s, s, pos, k, sha, h, p) for s, pos, k, sha, h, p in rows], schema)
    got = {r["submission"]: r["messages"] for r in duplicates.greedy_messages(df, threshold, fold_rows=block, crowd=0).collect()}
    assert got == scan(rows, threshold) and got
    assert duplicates.greedy_messages(df.limit(0), threshold, crowd=0).isEmpty()


def test_scoring_keeps_methods_that_the_jvm_compiles(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    df = bind.standard(spark, SF).withColumns({"has_pdf": F.lit(True), "pdf_empty": F.lit(False), "pdf_expert": F.lit(False)})
    pipeline.scored(df)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_crowded_hashes_are_compared_without_pieces(spark, monkeypatch):
    """At a threshold of 11 of 16 pieces are 4368 rows a hash, which outgrow the pairs; crowded hashes are compared all, in slices, and settled without their pairs."""
    monkeypatch.setattr(duplicates, "SLICE", 300)
    monkeypatch.setattr(duplicates, "best_blocks", lambda *_: pytest.fail("pieces of crowded hashes"))
    rng = random.Random(3)
    texts = [f"{rng.getrandbits(64):016x}" for _ in range(700)]
    df = spark.createDataFrame([(i, i, 0, "k", f"s{i}", h, f"p{i}") for i, h in enumerate(texts)], "submission long, ord long, pos int, key string, sha256 string, phash string, path string")
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(min(a, b), max(a, b), apart(a, b)) for i, a in enumerate(texts) for b in texts[:i] if apart(a, b) <= 11}
    assert {tuple(r) for r in duplicates.near_hashes(df, 11).collect()} == want and len(want) > 300
    monkeypatch.setattr(duplicates, "near_among", lambda *_: pytest.fail("pairs of crowded hashes"))
    got = {r["submission"]: r["messages"] for r in duplicates.greedy_messages(df, 11, fold_rows=50).collect()}
    assert got == scan([(i, 0, "k", f"s{i}", h, f"p{i}") for i, h in enumerate(texts)], 11)


def test_a_pair_of_near_hashes_meets_once(spark, monkeypatch):
    """Each pair of hashes is looked up and sent to its photos once, not from both sides."""
    rng = random.Random(5)
    texts = [f"{rng.getrandbits(64):016x}" for _ in range(60)]
    rows = [(i, 1000 - i // 2, i % 2, f"{texts[rng.randrange(60)]}") for i in range(150)]
    df = spark.createDataFrame(rows, "submission long, ord long, pos int, phash string")
    asked, near = [], duplicates.near_hashes
    monkeypatch.setattr(duplicates, "near_hashes", lambda *a: asked.append(near(*a)) or asked[-1])
    pairs = duplicates.near_pairs(df, 11)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == asked[0]._jdf.queryExecution().optimizedPlan().toString().count("Join") + 2 and "Union" not in plan
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(*a[1:3], a[0], *b[1:3], b[0], apart(a[3], b[3])) for a in rows for b in rows if a[1:3] < b[1:3] and a[3] != b[3] and apart(a[3], b[3]) <= 11}
    got = [tuple(r) for r in pairs.select("a_ord", "a_pos", "a_submission", "b_ord", "b_pos", "b_submission", "distance").collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_pairs_of_crowded_hashes_are_not_shuffled(spark, monkeypatch):
    """They grow with the square of the photos, and so would the disk: photos meet in blocks, and nothing is dealt out behind that. A hash that many share lies in several blocks."""
    for name, value in (("BLOCK", 40), ("BLOCKS", 2), ("STEP", 300), ("BATCH", 50)):
        monkeypatch.setattr(duplicates, name, value, raising=False)
    rng = random.Random(7)
    texts = [f"{rng.getrandbits(64):016x}" for _ in range(500)]
    some = [texts[0]] * 90 + [texts[0][:-2] + "zz"] * 45 + ["Z" * 16, "Z" * 15 + "\u0416", "", "", "0", "1", texts[1][:-1], texts[2][:-1], texts[2][:-2] + "\U0001f600", texts[1][:-1] + "\u0416", None]
    rows = [(f"s{i}", 1000 - i // 2, i % 2, h) for i, h in enumerate([*texts, *some])]
    df = spark.createDataFrame(rows, "submission string, ord long, pos int, phash string")
    pairs = duplicates.near_pairs(df, 11)
    plan = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line or "CartesianProduct" in line]
    assert len(joins) == 1 and not any("Exchange" in line for line in plan[: joins[0]])
    near = lambda a, b: a is not None and b is not None and a != b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 11
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(*a[1:3], a[0], *b[1:3], b[0], apart(a[3], b[3])) for a in rows for b in rows if a[1:3] < b[1:3] and near(a[3], b[3])}
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 90 * 45
    bare = duplicates.near_pairs(df.drop("submission"), 11)
    assert bare.columns == ["a_ord", "a_pos", "b_ord", "b_pos", "distance"] and {tuple(r) for r in bare.collect()} == {(*r[:2], *r[3:5], r[6]) for r in want}


def test_scoring_does_not_plan_the_scan_again(spark):
    """What photos repeat is a staged table where it is joined: one join, without the scan's own, and nothing of it in Python."""
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = [(1, 1, 0, "k", "x", "0" * 16, "p"), (2, 2, 0, "k", "x", "5" * 16, "q"), (3, 3, 0, "k", "z", "9" * 16, "r")]
    images = spark.createDataFrame(rows, "submission long, ord long, pos int, key string, sha256 string, phash string, path string")
    out = pipeline.with_duplicates(df, images, "id", 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "MapInPandas" not in plan and "parquet" in plan
    assert {r["id"]: r["duplicate_messages"] for r in out.collect()} == {1: None, 2: ["Image identical to submission 1 (SHA256 match)"], 3: None}


def test_many_duplicates_are_not_broadcast(spark, monkeypatch):
    """The files of what photos repeat compress well, so their size does not tell whether the driver can hold it."""
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 1, raising=False)
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = [(i, i, 0, "k", "x", None, "p") for i in (1, 2, 3)]
    images = spark.createDataFrame(rows, "submission long, ord long, pos int, key string, sha256 string, phash string, path string")
    out = pipeline.with_duplicates(df, images, "id", 5)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    told = ["Image identical to submission 1 (SHA256 match)"]
    assert {r["id"]: r["duplicate_messages"] for r in out.collect()} == {1: None, 2: told, 3: told}


def test_greedy_duplicates_of_the_survey(spark):
    far = {"x": "0" * 16, "y": "5" * 16, "z": "9" * 16, "q": "f" * 16}
    rows = [(1, 0, "x"), (1, 1, "y"), (2, 0, "x"), (2, 1, "z"), (3, 0, "z"), (4, 0, "z"), (5, 0, "q"), (5, 1, "q")]
    df = spark.createDataFrame([(s, s, pos, "k", c, far[c], c) for s, pos, c in rows], "submission long, ord long, pos int, key string, sha256 string, phash string, path string")
    assert {r["submission"]: r["flagged"] for r in duplicates.greedy(df, 5).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    assert duplicates.greedy(df.limit(0), 5).isEmpty()


def chain(n):
    """n photos of n submissions, each hash near the one before and the one after only."""
    digits = "0123456789abcdef"
    hashes = []
    for i in range(n):
        hashes.append("".join(digits[(i + 15 - j) // 16 * 7 % 16] for j in range(16)))
    return [(i, 0, "k", f"s{i}", h, f"p{i}") for i, h in enumerate(hashes)]


def test_a_chain_takes_as_many_jobs_as_a_pair(spark):
    """Each photo is near the one before, so every second one of the chain is remembered; the number of jobs does not grow with the chain."""
    jobs, schema = {}, "submission long, ord long, pos int, key string, sha256 string, phash string, path string"
    for n in (4, 1000):
        rows = chain(n)
        df = stage(spark.createDataFrame([(s, s, pos, k, sha, h, p) for s, pos, k, sha, h, p in rows], schema), "chain")
        spark.sparkContext.setJobGroup(f"chain {n}", "")
        got = {r["submission"]: r["messages"] for r in duplicates.greedy_messages(df, 1).collect()}
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain {n}"))
        assert got == scan(rows, 1) and len(got) >= n // 2
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1000] <= jobs[4] + 6  # further jobs of a plan that adapts to larger tables


@pytest.mark.parametrize("local", [5, 10**6])
def test_components(spark, local):
    rng = random.Random(4)
    name = {i: rng.getrandbits(62) for i in range(300)}
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(200, 280)] + [(7, 7)]
    got = {r.node: r.label for r in duplicates.components(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a long, b long"), local).collect()}
    parent = list(range(300))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in edges:
        parent[root(a)] = root(b)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == {name[i] for i in ends}
    assert all((got[name[a]] == got[name[b]]) == (root(a) == root(b)) for a in ends for b in ends)


def test_blocks_lose_no_pair():
    """Every choice of hashes within the threshold agrees on one block at least, whatever the number of pieces."""
    rng = random.Random(7)
    for threshold in (0, 2, 5, 11):
        for pieces in range(threshold + 1, 17):
            chosen = duplicates.blocks(threshold, pieces)
            for _ in range(20):
                a = [rng.choice("0123") for _ in range(16)]
                b = list(a)
                for i in rng.sample(range(16), threshold):
                    b[i] = "z"
                assert any(all(a[s - 1 : s - 1 + n] == b[s - 1 : s - 1 + n] for s, n in spans) for spans in chosen)


# --- quota ---


def test_breaker():
    b = quota.Breaker()
    for i in range(19):
        b.record(i * 0.01, "limit")
    assert b.state == "CLOSED"
    b.record(0.2, "limit")
    assert b.state == "OPEN" and not b.can_proceed(5.0) and b.can_proceed(10.2)
    b.record(10.2, "success")
    assert b.state == "HALF_OPEN"
    b.record(10.2, "success")
    assert b.state == "CLOSED" and (b.requests, b.errors) == (22, 20)
    b.record(10.3, "limit")  # the window still holds the errors: 21 of 23
    assert b.state == "OPEN"
    b = quota.Breaker()
    for i in range(29):
        b.record(i * 0.01, "limit" if i < 20 else "error")
    assert b.state == "OPEN"
    b = quota.Breaker()
    for i in range(29):
        b.record(i * 0.01, "success" if i < 9 else "limit")
    assert b.state == "CLOSED"
    b.record(31.0, "success")
    assert (b.requests, b.errors, b.window) == (0, 0, 31.0)
    b.state, b.until = "OPEN", 40.0
    assert b.can_proceed(41.0)
    b.record(41.0, "error")
    assert b.state == "OPEN" and b.until == 51.0


def test_admission():
    a = quota.Admission(3, 60.0)
    waits = []
    for now in (0.0, 1.0, 40.0, 45.0):
        waits.append(round(a.delay(now, 1500), 6))
        a.record(now)
    assert waits == [0.0, round(19 * 1.1, 6), 0.0, round(15.1 * 1.1, 6)]
    assert effective_limit(148, 0.98) == 140 and effective_limit(25, 0.8) == 20


def test_rolling_counts_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.choice([0, 5, 3600, 3595, 3660, 7200]) + rng.randrange(200)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id int, k string, s int").select("event_id", "k", F.timestamp_seconds("s").alias("ts"))
    want = {i: sum(k == k2 and s - 60 <= s2 <= s for _, k2, s2 in rows) for i, k, s in rows}
    assert {r.event_id: r.in_window for r in quota.rolling(df, "k", 60).collect()} == want


def test_budget_of_a_hot_id(spark):
    rows = [(i % 7 == 0 and "hot" or f"i{i % 5}", i, s) for i in range(300) for s in (1, 2, 3)]
    got = quota.granted(spark.createDataFrame(rows, "id string, idx int, step int")).collect()
    want = {}
    for key, idx, s in sorted(rows, key=lambda r: r[1:]):
        want[key, idx, s] = sum(k[0] == key for k in want) < 5
    assert {(r.id, r.idx, r.step): r.granted for r in got} == want


# --- the pipeline ---


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def inputs(spark):
    """An empty table with all columns that scoring takes, duplicates as a column of it."""
    df = bind.standard(spark, SF).withColumns({"has_pdf": F.lit(True), "pdf_empty": F.lit(False), "pdf_expert": F.lit(False), "duplicate_messages": F.array(F.lit("x"))})
    return spark.createDataFrame([], df.schema)


def test_orders_are_not_broadcast_by_the_size_of_their_files(spark):
    """Files of millions of orders may be as small as these."""
    assert "BroadcastHashJoin" not in bind.submissions(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_a_projection(spark):
    df = pipeline.scored(inputs(spark)).select("score", "unmet")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_scoring_copies_no_expression(spark):
    """The plan of all scores stays small: what several rules use is computed once."""
    df = pipeline.scored(bind.standard(spark, SF).withColumns({"has_pdf": F.lit(True), "pdf_empty": F.lit(False), "pdf_expert": F.lit(False)}))
    assert len(plan_of(df.select("id", "status", "unmet"))) < 40_000 and len(plan_of(pipeline.long(df).drop("message"))) < 60_000


def test_own_rules_and_switches(spark):
    df = bind.with_reports(bind.standard(spark, SF).limit(30), spark, SF)
    own = rules.Outcome(rules.Rule("own", 18, "Even", 5), F.col("id") % 2 == 0, F.lit("odd"))
    out = pipeline.scored(df, EngineConfig(enable_year=True, enable_geotag=True, current_year=1996), [own])
    kinds = {r.criterion for r in pipeline.long(out).collect()}
    assert {"Even", "Year alignment (financial vs academic)", "GeoTag present"} <= kinds
    plain = {r.criterion for r in pipeline.long(pipeline.scored(df)).collect()}
    assert not {"Even", "Year alignment (financial vs academic)", "GeoTag present"} & plain


def test_output_keeps_raw_names(spark):
    raw = spark.createDataFrame([(1, "old", 5, "T")], "id int, status string, score int, activity_name string")
    df = mapping.mapped(raw).withColumns({n: F.lit(False) for n in ("has_pdf", "pdf_empty", "pdf_expert")}).withColumns({"n_images": F.lit(0), **{f"{n}_answer": F.lit("NO") for n in ("theme", "pdf", "image")}})
    out = pipeline.output(pipeline.scored(df), level=True)
    assert out.columns == ["id", "status", "score", "activity_name", "Overall Score", "Status", "Requirements Not Met", "Level"]
    assert tuple(out.first())[:6] == (1, "old", 5, "T", 15, "Reopen")


def test_numbered(spark):
    df = stage(spark.range(1000).select((F.col("id") * 7919 % 1009 % 300).alias("v")), "v")
    got = numbered(df, ["v"], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and [r.v for r in got] == sorted(i * 7919 % 1009 % 300 for i in range(1000))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_catalogue(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_every_query_has_sql():
    from rubrica.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES)
