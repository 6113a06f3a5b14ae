"""Call budgets, rolling rates, admission delays and the circuit breaker.

Keys may hold any share of the rows: budgets keep a bounded number of rows a key before they shuffle, rates are cut into spans of time. Admission and the
breaker are state machines, whose calls have an order within a key; they stream through sorted partitions with a state of fixed size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.plans.staging import stage

SALTS = 64


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def effective_limit(rpm: Column, safety: Column) -> Column:
    """Requests a minute that a limiter admits, as config.effective_limit()."""
    return (rpm * F.least(safety, F.lit(0.95))).cast("int")


def last_granted(calls: DataFrame, max_calls: int = 5) -> DataFrame:
    """(id, cut) of each id: the last call (idx, step) within its budget. No task sees more than its share of an id's calls."""
    salted = calls.select("id", "idx", "step").withColumn("salt", F.pmod(F.xxhash64("idx", "step"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("id", "salt").orderBy("idx", "step"))).where(F.col("n") <= max_calls)
    least = few.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("idx", "step"))).where(F.col("n") <= max_calls)
    return least.groupBy("id").agg(F.max(F.struct("idx", "step")).alias("cut"))


def granted(calls: DataFrame, max_calls: int = 5) -> DataFrame:
    """calls(id, idx, step): refusals only follow exhaustion, so the first max_calls of an id are granted. calls are read twice, so staged."""
    calls = stage(calls, "calls")
    return calls.join(last_granted(calls, max_calls), "id", "left").withColumn("granted", F.coalesce(F.struct("idx", "step") <= F.col("cut"), F.lit(False))).drop("cut")


def budget_summary(calls: DataFrame, max_calls: int = 5) -> DataFrame:
    """(id, used, max_calls, remaining, history): the history is the steps granted, in order."""
    n, calls = F.count("*"), stage(calls, "calls")
    sums = calls.groupBy("id").agg(F.least(n, F.lit(max_calls)).alias("used"), F.lit(max_calls).alias("max_calls"), F.greatest(F.lit(0), max_calls - n).alias("remaining"))
    kept = granted(calls, max_calls).where("granted").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "step"))).alias("h"))
    return sums.join(kept.select("id", F.transform("h", lambda x: x["step"]).alias("history")), "id")


def rolling(log: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """log(key, ts) with the events of the last `seconds`, the present one too.

    Time is cut into spans of 60 windows; an event in the last window of a span also counts in the next, so a span is a task of its own.
    """
    width, span = seconds * 1_000_000, 60 * seconds * 1_000_000
    at, own = micros(), F.floor(micros() / F.lit(span))
    late = at >= (own + 1) * span - width
    spans = F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    w = Window.partitionBy(key, "rolling_span").orderBy("rolling_at").rangeBetween(-width, 0)
    out = log.withColumns({"rolling_at": at, "rolling_own": own}).withColumn("rolling_span", spans).withColumn("in_window", F.count("*").over(w))
    return out.where(F.col("rolling_span").eqNullSafe(F.col("rolling_own"))).drop("rolling_at", "rolling_own", "rolling_span")


class Admission:
    """A limiter: at most `limit` requests in `period` seconds, evenly spaced; requests are recorded when they are let through."""

    def __init__(self, limit: int, period: float = 60.0) -> None:
        self.limit, self.period = limit, period
        self.times: deque[float] = deque(maxlen=2 * limit)
        self.last = float("-inf")

    def delay(self, now: float, tokens: int = 0) -> float:
        while self.times and self.times[0] < now - self.period:
            self.times.popleft()
        factor = 1.2 if tokens > 2000 else 1.1 if tokens > 1000 else 1.0
        if len(self.times) >= self.limit:
            return max(0.0, self.times[0] + self.period - now + 0.1) * factor
        return max(0.0, self.period / self.limit - (now - self.last)) * factor

    def record(self, now: float) -> None:
        self.times.append(now)
        self.last = now


def in_order(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    return log.repartition(key).sortWithinPartitions(key, *order)


def folded(log: DataFrame, key: str, step: Callable[[], Callable[[tuple], tuple]], fields: list[str], out: str) -> DataFrame:
    """(key, event_id, *out): a state machine for each key, fed with its rows in order of (ts, event_id).

    `step()` makes a machine: a function from a row's fields to its results. The partition is sorted by Spark, which spills, and read as a stream.
    """
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, machine = object(), None
        for pdf in batches:
            got = []
            for k, *row in zip(pdf["key"], *(pdf[f] for f in fields), strict=True):
                k = None if pd.isna(k) else k
                if machine is None or k != own:
                    own, machine = k, step()
                got.append(machine(row))
            yield pd.DataFrame({key: pdf["key"], "event_id": pdf["event_id"]} | {n: [g[i] for g in got] for i, n in enumerate(names)})

    rows = log.select(F.col(key).alias("key"), "event_id", (micros() / 1e6).alias("at"), *[f for f in fields if f != "at"])
    return in_order(rows, "key", ["at", "event_id"]).mapInPandas(run, f"`{key}` {dict(log.dtypes)[key]}, event_id long, {out}")


def admitted(log: DataFrame, key: str, limit: int, tokens: str, period: float = 60.0) -> DataFrame:
    """(key, event_id, delay): seconds that each call of a key waits, when waits hold up the calls behind it (no jitter)."""

    def start():
        limiter, free = Admission(limit, period), [float("-inf")]

        def machine(row):
            at, n = row
            now = max(at, free[0])
            delay = limiter.delay(now, n)
            free[0] = now + delay
            limiter.record(free[0])
            return (now - at + delay,)

        return machine

    return folded(log.withColumn("tokens", F.col(tokens)), key, start, ["at", "tokens"], "delay double")


def error_rate(log: DataFrame, key: str, seconds: int = 30) -> DataFrame:
    slot = F.window("ts", f"{seconds} seconds")
    return log.groupBy(key, slot.alias("w")).agg(F.count("*").alias("requests"), F.count_if("is_error").alias("errors")).select(key, F.col("w.start").alias("window_start"), "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate"))


class Breaker:
    """CLOSED, OPEN and HALF_OPEN over a stream of (time, outcome); outcomes are success, limit and error.

    Only limits count as errors of the rate. The window begins with the first call.
    """

    FIELDS = ("state", "until", "window", "requests", "errors", "good")

    def __init__(self, config: EngineConfig = EngineConfig()) -> None:
        self.c = config
        self.state, self.until, self.window = "CLOSED", 0.0, -1.0
        self.requests = self.errors = self.good = 0

    def can_proceed(self, now: float) -> bool:
        if self.state == "OPEN" and now >= self.until:
            self.state, self.good = "HALF_OPEN", 0
        return self.state != "OPEN"

    def record(self, now: float, outcome: str) -> None:
        if self.window < 0:
            self.window = now
        self.requests += 1
        self.errors += outcome == "limit"
        if outcome == "success":
            if self.state == "HALF_OPEN":
                self.good += 1
                if self.good == 2:
                    self.state, self.good = "CLOSED", 0
            elif self.state == "OPEN":
                self.errors = max(0, self.errors - 1)
        else:
            if self.state == "HALF_OPEN":
                self.open(now)
            enough = self.errors >= self.c.breaker_min_errors and self.requests >= self.c.breaker_min_requests
            if self.state == "CLOSED" and enough and self.errors / self.requests >= self.c.breaker_rate:
                self.open(now)
        if now - self.window > self.c.breaker_window_s:
            self.window, self.requests, self.errors = now, 0, 0

    def open(self, now: float) -> None:
        self.state, self.until, self.good = "OPEN", now + self.c.breaker_cooldown_s, 0


def breaker(log: DataFrame, key: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """log(key, ts, event_id, outcome) as (key, event_id, allowed, state): whether each call may go, and the state after it."""

    def start():
        b = Breaker(config)

        def machine(row):
            at, outcome = row
            ok = b.can_proceed(at)
            if ok:
                b.record(at, outcome)
            return ok, b.state

        return machine

    return folded(log, key, start, ["at", "outcome"], "allowed boolean, state string")
