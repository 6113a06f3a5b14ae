"""Queries of the budgets, rates, delays, errors and the breaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.functions import scalars as S
from rubrica.operators import quota
from rubrica.plans import bind, pipeline
from rubrica.plans.queries import c, query, reported
from rubrica.plans.queries.scoring import PARTS

#: Ids are shared by many rows here, so that budgets run out.
SHARED = "id % 5000"
CALLS = f"calls AS (SELECT {SHARED} AS bid, id, step FROM u, (VALUES (1), (2), (3)) v(step) WHERE NOT broken AND (step = 1 OR (step = 2 AND has_pdf) OR (step = 3 AND n_images > 0))), ranked AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY id, step) AS rn FROM calls)"


def calls(d: DataFrame) -> DataFrame:
    return pipeline.calls(d, c("id") % 5000, "id")


@reported("call_budget", f", {CALLS} SELECT bid AS id, id AS idx, step, rn <= 5 AS granted FROM ranked")
def call_budget(d: DataFrame) -> DataFrame:
    return quota.granted(calls(d))


@reported("budget_summary", f", {CALLS} SELECT bid AS id, least(count(*), 5) AS used, 5 AS max_calls, greatest(0, 5 - count(*)) AS remaining, string_agg(step, ',' ORDER BY rn) FILTER (rn <= 5) AS history FROM ranked GROUP BY bid")
def budget_summary(d: DataFrame) -> DataFrame:
    return quota.budget_summary(calls(d)).withColumn("history", F.array_join(F.transform("history", lambda x: x.cast("string")), ","))


@reported(
    "budget_denied",
    f""", {CALLS}, flags AS (SELECT id, bool_or(step = 1 AND rn > 5) AS d1, bool_or(step = 2 AND rn > 5) AS d2, bool_or(step = 3 AND rn > 5) AS d3 FROM ranked GROUP BY id), {PARTS}
SELECT id, CAST(CASE WHEN d1 THEN 1 ELSE 3 END + CASE WHEN has_pdf THEN 5 ELSE 1 END + CASE WHEN n_images = 0 THEN 1 WHEN d3 THEN 5 ELSE 4 END + 1 AS INT) AS n,
  CAST(CASE WHEN d1 THEN 1 ELSE 0 END + CASE WHEN d2 THEN 5 ELSE 0 END + CASE WHEN d3 THEN 5 ELSE 0 END AS INT) AS n_denied,
  CAST(CASE WHEN d1 THEN 0 ELSE theme_p END + CASE WHEN d2 THEN 0 ELSE pdf_p END + CASE WHEN d3 THEN 0 ELSE image_p END + 15 AS INT) AS score
FROM z JOIN flags USING (id)""",
)
def budget_denied(d: DataFrame) -> DataFrame:
    """Results of rows whose id has used up its calls: one for the theme, five each for PDF and images."""
    out = pipeline.scored(pipeline.with_budget(d, c("id") % 5000, "id")).where("broken is null")
    denied = F.size(F.filter("results", lambda r: r["message"].contains("budget exhausted")))
    return out.select("id", F.size("results").alias("n"), denied.alias("n_denied"), "score")


ROLL = "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)"


@query("rolling_rate", f"SELECT event_id, {ROLL} AS in_window FROM events")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    return quota.rolling(bind.load(spark, d, "events"), "user_id", 3600).select("event_id", "in_window")


@query("available_quota", f"SELECT event_id, greatest(0, 3 - {ROLL}) AS available FROM events")
def available_quota(spark: SparkSession, d: str) -> DataFrame:
    return quota.rolling(bind.load(spark, d, "events"), "user_id", 3600).select("event_id", F.greatest(F.lit(0), 3 - c("in_window")).alias("available"))


DAY, LIMIT = 86400.0, 2
FACTOR = "CASE WHEN tokens > 2000 THEN 1.2::DOUBLE WHEN tokens > 1000 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END"
FRESH = f"list_filter(times, lambda t: t >= now - {DAY}::DOUBLE)"


@query(
    "admission_delay",
    f"""WITH RECURSIVE log AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_id % 3000 AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run AS (
  SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS times, CAST('-inf' AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS delay FROM log GROUP BY user_id
  UNION ALL
  SELECT user_id, event_id, n, list_append(fresh, now + own), now + own, now - t + own FROM (
    SELECT *, CASE WHEN len(fresh) >= {LIMIT} THEN greatest(0, fresh[1] + {DAY}::DOUBLE - now + 0.1::DOUBLE) * {FACTOR} ELSE greatest(0, {DAY / LIMIT}::DOUBLE - (now - last)) * {FACTOR} END AS own
    FROM (SELECT *, {FRESH} AS fresh FROM (
      SELECT l.user_id, l.event_id, l.n, l.t, l.tokens, r.last, greatest(l.t, r.last) AS now, r.times[greatest(1, len(r.times) - {2 * LIMIT - 1}):] AS times FROM run r JOIN log l ON l.user_id = r.user_id AND l.n = r.n + 1))))
SELECT event_id, round(delay, 3) AS delay FROM run WHERE n > 0""",
)
def admission_delay(spark: SparkSession, d: str) -> DataFrame:
    """Two calls a day for each user, each call held up by the waits before it."""
    log = bind.load(spark, d, "events").withColumn("tokens", c("event_id") % 3000)
    return quota.admitted(log, "user_id", LIMIT, "tokens", DAY).select("event_id", F.round("delay", 3).alias("delay"))


@query("error_rate_window", "SELECT user_id, time_bucket(INTERVAL 30 SECONDS, ts) AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') / count(*) AS error_rate FROM events GROUP BY 1, 2")
def error_rate_window(spark: SparkSession, d: str) -> DataFrame:
    return quota.error_rate(bind.load(spark, d, "events").withColumn("is_error", c("event_type") == "error"), "user_id")


#: Events are hours apart, so the breaker is set to days.
SLOW = EngineConfig(breaker_rate=0.4, breaker_window_s=3 * DAY, breaker_cooldown_s=DAY / 2, breaker_min_errors=2, breaker_min_requests=3)
OPENS = f"errors >= {SLOW.breaker_min_errors} AND requests >= {SLOW.breaker_min_requests} AND errors / requests >= {SLOW.breaker_rate}::DOUBLE"


@query(
    "circuit_breaker",
    f"""WITH RECURSIVE log AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, CASE event_type WHEN 'error' THEN 'limit' WHEN 'signup' THEN 'error' ELSE 'success' END AS outcome,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run AS (
  SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, true AS allowed, 'CLOSED' AS state, CAST(0 AS DOUBLE) AS until, min(t) AS win, 0 AS requests, 0 AS errors, 0 AS good FROM log GROUP BY user_id
  UNION ALL
  SELECT user_id, event_id, n, allowed, after, CASE WHEN opened THEN t + {SLOW.breaker_cooldown_s}::DOUBLE ELSE until END, CASE WHEN late THEN t ELSE win END,
    CASE WHEN late THEN 0 ELSE requests END, CASE WHEN late THEN 0 ELSE errors END, CASE WHEN after = 'HALF_OPEN' THEN good ELSE 0 END
  FROM (SELECT *, allowed AND outcome <> 'success' AND (state = 'HALF_OPEN' OR {OPENS}) AS opened, allowed AND t - win > {SLOW.breaker_window_s}::DOUBLE AS late,
      CASE WHEN allowed AND outcome <> 'success' AND (state = 'HALF_OPEN' OR {OPENS}) THEN 'OPEN' WHEN state = 'HALF_OPEN' AND good = 2 THEN 'CLOSED' ELSE state END AS after
    FROM (SELECT user_id, event_id, n, t, outcome, allowed, state, until, win, requests + CAST(allowed AS INT) AS requests, errors + CAST(allowed AND outcome = 'limit' AS INT) AS errors,
        good + CAST(allowed AND state = 'HALF_OPEN' AND outcome = 'success' AS INT) AS good
      FROM (SELECT l.*, r.until, r.win, r.requests, r.errors, NOT (r.state = 'OPEN' AND l.t < r.until) AS allowed, CASE WHEN r.state = 'OPEN' AND l.t >= r.until THEN 'HALF_OPEN' ELSE r.state END AS state,
          CASE WHEN r.state = 'HALF_OPEN' THEN r.good ELSE 0 END AS good
        FROM run r JOIN log l ON l.user_id = r.user_id AND l.n = r.n + 1))))
SELECT event_id, allowed, state FROM run WHERE n > 0""",
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(c("event_type") == "error", "limit").when(c("event_type") == "signup", "error").otherwise("success")
    return quota.breaker(bind.load(spark, d, "events").withColumn("outcome", outcome), "user_id", SLOW).select("event_id", "allowed", "state")


@query("effective_limit", "SELECT s_suppkey, CAST(trunc((s_suppkey % 300) * least((s_suppkey % 101) / 100::DOUBLE, 0.95::DOUBLE)) AS INT) AS admitted FROM supplier")
def effective_limit(spark: SparkSession, d: str) -> DataFrame:
    """Limits of as many providers as there are suppliers."""
    return bind.load(spark, d, "supplier").select("s_suppkey", quota.effective_limit(c("s_suppkey") % 300, (c("s_suppkey") % 101) / 100).alias("admitted"))


# --- errors ---


def messages(spark: SparkSession, d: str) -> DataFrame:
    k = c("event_id")
    number = lambda m: (k % m).cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Please RETRY in "), number(60), F.lit(".5s"))).when(k % 6 == 1, "429 quota").when(k % 6 == 2, F.concat(F.lit("rate limit: wait "), number(9), F.lit(" seconds")))
        .when(k % 6 == 3, "timeout").when(k % 6 == 4, "retry_delay { seconds: 49 }").otherwise("Resource_Exhausted, try again in 2s")
    )
    return bind.load(spark, d, "events").select("event_id", text.alias("message"), (k % 3).cast("int").alias("attempt"))


NAMED = "CASE event_id % 6 WHEN 0 THEN CAST(event_id % 60 AS DOUBLE) + 0.5 WHEN 2 THEN CAST(event_id % 9 AS DOUBLE) WHEN 4 THEN 49.0 END"
FALLBACK = "CASE event_id % 6 WHEN 0 THEN CAST(event_id % 60 AS DOUBLE) + 1.0 WHEN 2 THEN CAST(event_id % 9 AS DOUBLE) + 0.5 WHEN 5 THEN 2.5 END"
POWER = "least(2 * pow(2.0, event_id % 3), 60.0)"


@query("retry_delay", f"SELECT event_id, CAST({NAMED} AS DOUBLE) AS first, CAST({FALLBACK} AS DOUBLE) AS fallback FROM events")
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("event_id", S.retry_delay(c("message")).alias("first"), S.retry_delay(c("message"), True).alias("fallback"))


@query(
    "backoff_schedule",
    f"""SELECT event_id, CASE WHEN event_id % 6 = 3 THEN 1.0 WHEN {NAMED} > 0 THEN greatest({NAMED}, 5.0) ELSE {POWER} END AS first,
  CASE WHEN event_id % 6 IN (3, 5) THEN 1.0 WHEN {FALLBACK} > 0 THEN {FALLBACK} ELSE {POWER} END AS fallback FROM events""",
)
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("event_id", S.backoff(c("message"), c("attempt")).alias("first"), S.backoff(c("message"), c("attempt"), True).alias("fallback"))


@query("classify_error", "SELECT event_id, event_id % 6 <> 3 AS first, event_id % 6 NOT IN (3, 5) AS fallback FROM events")
def classify_error(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("event_id", S.is_rate_limit(c("message")).alias("first"), S.is_rate_limit(c("message"), True).alias("fallback"))

