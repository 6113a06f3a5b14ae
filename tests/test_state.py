"""What outlives a batch, against sequential models of several batches."""

import csv
import random

import numpy as np
import pytest

from rubrica import __main__ as cli
from rubrica.operators import duplicates, quota
from rubrica.operators.state import BudgetLedger, PhotoIndex
from test_sources import png

PHOTOS = "submission long, ord long, pos int, key string, sha256 string, phash string, path string"


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99


class Directories:
    """The scan of several batches: bytes and hashes of a batch are forgotten with it, those of directories stay."""

    def __init__(self, threshold):
        self.threshold, self.known = threshold, {}

    def batch(self, rows):
        seen, out = {}, {}
        for s, _, key, sha, h, path in rows:
            said = out.setdefault(s, [])
            if sha is None:
                continue
            if sha in seen:
                said.append(f"Image identical to submission {seen[sha][0]} (SHA256 match)")
                continue
            folder = self.known.setdefault(key, {})
            if sha in folder:
                said.append(f"Image identical to file in directory (SHA256 match): {folder[sha][1]}")
            else:
                near = next(((p, apart(h, g)) for g, p in folder.values() if h and g and apart(h, g) <= self.threshold), None)
                if near:
                    said.append(f"Image similar to file in directory (pHash match (similarity score: {near[1]:.1f})): {near[0]}")
            other = next(((who, apart(h, g)) for who, g in seen.values() if h and g and g != h and apart(h, g) <= self.threshold), None)
            if other:
                said.append(f"Image similar to submission {other[0]} (pHash distance: {other[1]}, threshold: {self.threshold})")
            if not said:
                seen[sha] = (s, h)
                folder[sha] = (h, path)
        return {s: m for s, m in out.items() if m}


def photo_batches(seed, n_batches, n, alphabet, contents):
    rng, out = random.Random(seed), []
    for b in range(n_batches):
        rows = []
        for s in range(n):
            for pos in range(rng.choice([0, 1, 2, 2, 3])):
                sha = None if rng.random() < 0.05 else f"s{rng.randrange(contents)}"
                h = None if sha is None or int(sha[1:]) % 11 == 0 else "".join(random.Random(sha).choice(alphabet) for _ in range(16))
                rows.append((s, pos, rng.choice("kl"), sha, h, f"b{b}/{s}.{pos}"))
        out.append(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s, s, pos, k, sha, h, p) for s, pos, k, sha, h, p in rows], PHOTOS)


def scored(index, batch, df, threshold, **how):
    images = index.lookup(batch, df)
    found = duplicates.greedy_messages(images, threshold, **how)
    index.add(batch, duplicates.remembered(images, found))
    return {r["submission"]: r["messages"] for r in found.collect()}


@pytest.mark.parametrize("seed,alphabet,contents,how", [(1, "ab", 60, {}), (2, "abc", 40, {"fold_rows": 0}), (3, "abcdef", 25, {"fold_rows": 4})])
def test_directories_know_earlier_batches(spark, tmp_path, seed, alphabet, contents, how):
    """Three batches, one after the other; the second runs twice, as after a failure."""
    model, index = Directories(5), PhotoIndex(spark, str(tmp_path / "photos"), 5, buckets=4)
    for b, rows in enumerate(photo_batches(seed, 3, 25, alphabet, contents)):
        want = model.batch(rows)
        df = frame(spark, rows)
        for _ in range(2 if b == 1 else 1):
            assert scored(index, b, df, 5, **how) == want


def test_clearing_one_directory_forgets_only_it(spark, tmp_path):
    index = PhotoIndex(spark, str(tmp_path / "photos"), 5, buckets=4)
    rows = [(0, 0, "k", "x", "0" * 16, "k/x"), (1, 0, "l", "y", "f" * 16, "l/y")]
    again = frame(spark, [(5, 0, "k", "x", "0" * 16, "k/x2"), (6, 0, "l", "y", "f" * 16, "l/y2"), (7, 0, "m", "x", "0" * 16, "m/x")])
    assert scored(index, 0, frame(spark, rows), 5) == {}
    ask = lambda b: {r.key: (r.known_exact, r.known_near and tuple(r.known_near)) for r in index.lookup(b, again).collect()}
    assert ask(1) == {"k": ("k/x", ("k/x", 0)), "l": ("l/y", ("l/y", 0)), "m": (None, None)}
    index.clear(0, "k")
    assert ask(1) == {"k": (None, None), "l": ("l/y", ("l/y", 0)), "m": (None, None)}
    assert scored(index, 1, again, 5) == {6: ["Image identical to file in directory (SHA256 match): l/y"], 7: ["Image identical to submission 5 (SHA256 match)"]}
    assert ask(2)["k"][0] == "k/x2"
    index.clear(1)
    assert set(ask(2).values()) == {(None, None)}


def test_a_lookup_reads_only_its_buckets(spark, tmp_path):
    index = PhotoIndex(spark, str(tmp_path / "photos"), 5, buckets=64)
    index.add(0, frame(spark, [(i, 0, "k", f"s{i}", f"{i:016x}", f"p{i}") for i in range(200)]))
    probes = index.slots(frame(spark, [(0, 0, "k", "s7", None, "p")]))
    rows = index.log.before(1, probes)
    assert rows.select("bucket").distinct().count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


# --- budgets ---


@pytest.mark.parametrize("buckets", [1, 8])
def test_budgets_are_shared_by_batches(spark, tmp_path, buckets):
    """Three batches of calls; every batch runs twice, and the first once more at the end. One id makes a third of all calls."""
    rng, used = random.Random(8), {}
    ledger = BudgetLedger(spark, str(tmp_path / "budget"), 5, buckets)
    batches = [[(rng.choice(["hot", f"i{rng.randrange(30)}", f"i{rng.randrange(30)}"]), i, s) for i in range(20) for s in (1, 2, 3)] for _ in range(3)]
    wants, frames = [], []
    for b, rows in enumerate(batches):
        rows = sorted(set(rows), key=lambda r: r[1:])
        want = {}
        for key, idx, step in rows:
            want[key, idx, step] = used.get(key, 0) < 5
            used[key] = used.get(key, 0) + want[key, idx, step]
        df = spark.createDataFrame(rows, "id string, idx int, step int")
        wants.append(want)
        frames.append(df)
        for _ in range(2):
            assert {(r.id, r.idx, r.step): r.granted for r in ledger.granted(b, df).collect()} == want
    assert {r.id: (r.used, r.remaining) for r in ledger.summary(3).collect()} == {k: (v, 5 - v) for k, v in used.items() if v}
    assert {(r.id, r.idx, r.step): r.granted for r in ledger.granted(0, frames[0]).collect()} == wants[0]
    ledger.log.forget(1)
    assert {r.id: r.used for r in ledger.summary(2).collect()} == {k: n for k in used if (n := sum(v for (i, *_), v in wants[0].items() if i == k))}


def test_a_first_batch_equals_the_stateless_form(spark, tmp_path):
    rows = [(i % 7 == 0 and "hot" or f"i{i % 5}", i, s) for i in range(60) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id string, idx int, step int")
    answer = lambda out: {(r.id, r.idx, r.step): r.granted for r in out.collect()}
    assert answer(BudgetLedger(spark, str(tmp_path / "b")).granted(0, df)) == answer(quota.granted(df))
    numbers = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (None, 2, 1)], "id long, idx int, step int")
    assert answer(BudgetLedger(spark, str(tmp_path / "c"), 1).granted(0, numbers)) == {(1, 0, 1): True, (None, 1, 1): False, (None, 2, 1): False}


def test_command_line_keeps_state(spark, tmp_path):
    """Two batches whose rows share an id and a photo; the second one runs again."""
    folder = tmp_path / "container" / "photos"
    folder.mkdir(parents=True)
    rng = np.random.default_rng(2)
    for name in "ab":
        (folder / f"{name}.png").write_bytes(png(rng.integers(0, 256, (40, 40), dtype=np.uint8)))
    head = "id,activity_name,event_theme,activity_duration,student_participants,faculty_participants,event_driven,report,photo1\n"
    row = lambda i, n: f"{i},Talk {n},Theme,3,20,2,1,none.pdf,photos/{n}.png\n"
    (tmp_path / "one.csv").write_text(head + row(9, "a") * 1)
    (tmp_path / "two.csv").write_text(head + row(9, "a") + row(9, "b"))

    def told(batch, name):
        target = str(tmp_path / f"{name}.out.csv")
        options = ["--output-csv", target, "--files", str(tmp_path / "container"), "--state", str(tmp_path / "state"), "--batch", str(batch), "--log-level", "ERROR", "--non-interactive"]
        assert cli.main([str(tmp_path / name), *options]) == 0
        return [r["Requirements Not Met"] for r in csv.DictReader(open(target, encoding="utf-8-sig"))]

    assert not any("Image" in t.split("Duplicate Check")[-1] for t in told(0, "one.csv") if "Duplicate Check" in t)
    first = told(1, "two.csv")
    assert "identical to file in directory" in first[0] and "Duplicate Check" not in first[1]
    assert "budget exhausted" not in first[0]
    assert told(1, "two.csv") == first
    ledger = BudgetLedger(spark, str(tmp_path / "state" / "budgets"))
    assert {r.id: r.used for r in ledger.summary(2).collect()} == {"9": 5}


def test_the_photo_index_stores_bytes_once(spark, tmp_path):
    """The hash of a photo's bytes is the value of its slot -1, and found there; it is no column of all its rows besides."""
    index = PhotoIndex(spark, str(tmp_path / "photos"), 5, buckets=4)
    rows = spark.createDataFrame([(1, 1, 0, "k", "s1", "0" * 16, "p1"), (2, 2, 0, "k", "s2", None, "p2")], "submission long, ord long, pos int, key string, sha256 string, phash string, path string")
    index.add(0, rows)
    stored = index.log.before(1)
    assert "sha256" not in stored.columns and sorted(r["value"] for r in stored.where("slot = -1").collect()) == ["s1", "s2"]
    assert sorted(r["known_exact"] for r in index.lookup(1, rows).collect()) == ["p1", "p2"]
