"""Event-time twins of the quota operators, for Structured Streaming.

rolling() and breaker() give the batch operators' rows, event by event; they wait for the watermark, so the order of arrival does not matter within it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rubrica.config import EngineConfig
from rubrica.operators.quota import Breaker


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class InOrder(StatefulProcessor):
    """Events of a key in order of (time, id), whatever order they arrive in.

    An event waits until the watermark has passed it, when nothing earlier can arrive any more; a timer wakes the key then. `fold(state, due)` takes the key's
    state (a tuple, or null at first) and the due events, sorted, as tuples (at, event_id, *fields), and gives the new state and a row of results for each.
    """

    def __init__(self, key: str, fields: str, results: list[str], state: str, fold: Callable) -> None:
        self.key, self.fields, self.results, self.state_schema, self.fold = key, fields, results, state, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, event_id long{', ' + self.fields if self.fields else ''}")
        self.state = handle.getValueState("state", self.state_schema)

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["at", "event_id", *[f.split()[0] for f in self.fields.split(", ") if f]]
        events = [(int(at), int(e), *rest) for pdf in rows for at, e, *rest in pdf[names].itertuples(index=False, name=None)]
        self.waiting.appendList(events)
        self.wake(min(at for at, *_ in events))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        events = sorted(self.waiting.get(), key=lambda e: e[:2])
        n = sum(e[0] <= now for e in events)
        due, later = events[:n], events[n:]
        if later:
            self.waiting.put(later)
            self.wake(later[0][0])
        else:
            self.waiting.clear()
        if due:
            state, results = self.fold(self.state.get() if self.state.exists() else None, due)
            self.state.update(state)
            yield pd.DataFrame({self.key: [key[0]] * n, "event_id": [e[1] for e in due]} | {name: [r[i] for r in results] for i, name in enumerate(self.results)})

    def close(self) -> None:
        pass


def in_order(log: DataFrame, key: str, late: str, fields: str, results: str, state: str, fold: Callable) -> DataFrame:
    """log(key, ts, event_id, *fields) as (key, event_id, *results), each event once, when the watermark has passed it. Needs the settings ROCKSDB."""
    spark = log.sparkSession
    for name, value in ROCKSDB.items():
        if spark.conf.get(name, "") != value:
            raise ValueError(f"this stream keeps timers, which needs the setting {name} = {value}")
    names = [f.split()[0] for f in fields.split(", ") if f]
    rows = log.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), "event_id", *names)
    processor = InOrder(key, fields, [r.split()[0] for r in results.split(", ")], state, fold)
    out = f"`{key}` {dict(log.dtypes)[key]}, event_id long, {results}"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime")


def rolling(log: DataFrame, key: str, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(key, event_id, in_window): the events of the last `seconds` up to each event, itself too; the exact twin of quota.rolling().

    A key's state is the times of one window before the watermark and the events that wait for it.
    """
    width = seconds * 1_000_000

    def fold(state, due):
        times = np.sort(np.array([*(state[0] if state else []), *(at for at, *_ in due)], np.int64))
        at = np.array([e[0] for e in due], np.int64)
        counts = np.searchsorted(times, at, "right") - np.searchsorted(times, at - width)
        return (times[times > at[-1] - width].tolist(),), [(int(n),) for n in counts]

    return in_order(log, key, late, "", "in_window long", "times array<long>", fold)


def rolling_rate(log: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    """Calls in windows of 60 seconds that begin every 5; what a dashboard shows. rolling() has the exact number at each call."""
    return log.withWatermark("ts", late).groupBy(key, F.window("ts", "60 seconds", "5 seconds")).agg(F.count("*").alias("calls"))


def error_rate(log: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    return log.withWatermark("ts", late).groupBy(key, F.window("ts", "30 seconds")).agg(F.count("*").alias("requests"), F.count_if("is_error").alias("errors"))


def first_seen(images: DataFrame, late: str = "1 day") -> DataFrame:
    return images.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha256"])


def breaker(log: DataFrame, key: str, config: EngineConfig = EngineConfig(), late: str = "1 minute") -> DataFrame:
    """log(key, ts, event_id, outcome) as (key, event_id, allowed, state): whether each call may go, and the state after it; the exact twin of quota.breaker().

    A key's state is kept for good: the errors before a silence of any length still count at the next call, which may open the breaker.
    """

    def fold(state, due):
        b = Breaker(config)
        for name, value in zip(Breaker.FIELDS, state or (), strict=bool(state)):
            setattr(b, name, value)
        results = []
        for at, _, outcome in due:
            ok = b.can_proceed(at / 1e6)
            if ok:
                b.record(at / 1e6, outcome)
            results.append((ok, b.state))
        return tuple(getattr(b, f) for f in Breaker.FIELDS), results

    return in_order(log, key, late, "outcome string", "allowed boolean, state string", "state string, until double, window double, requests long, errors long, good long", fold)


def budget(calls: DataFrame, config: EngineConfig = EngineConfig(), late: str = "1 minute", keep_s: int = 86400) -> DataFrame:
    """(id, idx, step, granted) of calls(id, idx, step, ts): a counter for each id, which expires keep_s after its last call."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["idx", "step"])
        used = state.get[0] if state.exists else 0
        state.update((min(config.max_calls, used + len(pdf)),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, 1000 * (int(pdf["ts"].max().timestamp()) + keep_s)))
        yield pd.DataFrame({"id": pdf["id"], "idx": pdf["idx"], "step": pdf["step"], "granted": [used + i < config.max_calls for i in range(len(pdf))]})

    types = dict(calls.dtypes)
    schema = f"id {types['id']}, idx {types['idx']}, step {types['step']}, granted boolean"
    return calls.withWatermark("ts", late).groupBy("id").applyInPandasWithState(step, schema, "used int", "append", GroupStateTimeout.EventTimeTimeout)
