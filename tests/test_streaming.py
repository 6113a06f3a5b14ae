"""Streams against their batch forms: events arrive in any order over several micro-batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.operators import quota
from rubrica.streaming import monitor


@pytest.fixture
def rocksdb(spark):
    for name, value in monitor.ROCKSDB.items():
        spark.conf.set(name, value)
    yield
    for name in monitor.ROCKSDB:
        spark.conf.unset(name)


SCHEMA = "k string, event_id long, s double, outcome string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("k", "event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "outcome")


def arrive(spark, tmp_path, batches, make, name):
    """The rows that a stream gives for batches in this order."""
    where = tmp_path / name
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(str(where / str(i)))
        os.utime(next((where / str(i)).glob("part*")), (1000 + i, 1000 + i))
    stream = spark.readStream.schema(frame(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(where))
    query = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    query.processAllAvailable()
    query.stop()
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


def shuffled(rng, rows, n_batches, late):
    """Batches in which an event comes at most `late` seconds after a later one of an earlier batch; a last event lets the watermark pass all."""
    rows = sorted(rows, key=lambda r: r[2] + rng.uniform(0, late / 2))
    size = -(-len(rows) // n_batches)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    for b in batches:
        rng.shuffle(b)
    return [*batches, [("end", -1, 1e6, "success")], [("end", -2, 2e6, "success")]]


def events(rng, n, span, keys):
    rows = [(rng.choice(keys), i, round(1000 + rng.uniform(0, span), rng.choice([0, 3, 6])), rng.choice(["limit", "limit", "success", "error"])) for i in range(n)]
    return rows + [(k, n + i, s, o) for i, (k, _, s, o) in enumerate(rows[:20])]  # equal times


def test_breaker_equals_its_batch_form(spark, tmp_path, rocksdb):
    """Arrivals shuffled over three micro-batches: every call is allowed or not, with the state after it, as in one sorted log."""
    rng = random.Random(5)
    rows = events(rng, 250, 200, ["a", "b", "b", "b"])
    config = EngineConfig(breaker_rate=0.4, breaker_window_s=40, breaker_cooldown_s=7, breaker_min_errors=4, breaker_min_requests=6)
    want = sorted((tuple(r) for r in quota.breaker(frame(spark, rows), "k", config).collect()), key=str)
    assert {s for *_, s in want} == {"OPEN", "CLOSED", "HALF_OPEN"}
    got = arrive(spark, tmp_path, shuffled(rng, rows, 3, 50), lambda s: monitor.breaker(s, "k", config), "breaker_out")
    assert [r for r in got if r[0] != "end"] == want


def test_rolling_equals_its_batch_form(spark, tmp_path, rocksdb):
    rng = random.Random(6)
    rows = events(rng, 250, 300, ["a", "b", "b", "b"]) + [("b", 900, 1100.0, "x"), ("b", 901, 1160.0, "x"), ("b", 902, 1160.000001, "x")]
    want = sorted(((r.k, r.event_id, r.in_window) for r in quota.rolling(frame(spark, rows), "k", 60).collect()), key=str)
    got = arrive(spark, tmp_path, shuffled(rng, rows, 4, 50), lambda s: monitor.rolling(s, "k", 60), "rolling_out")
    assert [r for r in got if r[0] != "end"] == want


def test_timers_need_their_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        monitor.breaker(frame(spark, [("a", 1, 1.0, "x")]), "k")
