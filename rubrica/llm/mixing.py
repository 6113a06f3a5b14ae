"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. alpha is bisected on a grid of 2**-20
so that the mixture meets a target entropy (nats) or keeps every source within a repetition limit. Without a
token budget the smallest budget is taken that uses each source whole at least once, so no document is lost
and only small sources repeat.

A source's quota is spent in passes: each pass is a permutation of its documents by md5 of seed, pass and
doc_id; the last pass ends before the first document (and all documents of equal key) that would exceed
the quota. Equal slices of all quotas form the blocks, so every block holds the mixture's weights.

Tokens are words between white space. Defined results: a null or empty text has no tokens and travels with its
source; a null source is a source of its own; a source without tokens is used once; equal ids share a key
and enter a pass together; repeated rows repeat; an empty table gives no rows; extra columns are ignored
by schedule() and kept by mixed(). The number of sources (not of rows) is held by the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import fresh, stage, table
from rubrica.llm.order import running

MAX_REPEATS, BLOCKS, GRID, SEED = 2.0, 16, 1 << 20, 17


def tokens():
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def named():
    """The source as a text without nulls: a null source is 'null', others start with '='."""
    return F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))


def order_key(a_pass):
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), a_pass.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def weights(totals: dict[str, int], alpha: float) -> dict[str, float]:
    top = max(totals.values())
    raw = {s: (t / top) ** alpha for s, t in totals.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def repeats(totals: dict[str, int], alpha: float, budget: int | None) -> dict[str, float]:
    """Passes over each source: by the budget, or such that the least is one."""
    if budget is None:
        top = max(totals.values())
        return {s: (top / t) ** (1 - alpha) for s, t in totals.items()}
    return {s: budget * x / totals[s] for s, x in weights(totals, alpha).items()}


def bisect_alpha(totals: dict[str, int], *, max_repeats: float | None = None, target_entropy: float | None = None, budget: int | None = None) -> float:
    """The least alpha in [0, 1] that keeps the repetition limit, or the largest in [0, 4] that keeps the entropy."""
    lo, hi = 0, GRID if target_entropy is None else 4 * GRID
    if target_entropy is None:
        good = lambda k: max(repeats(totals, k / GRID, budget).values()) <= max_repeats
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if good(mid) else (mid + 1, hi)
        return lo / GRID
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if entropy(weights(totals, mid / GRID)) >= target_entropy else (lo, mid - 1)
    return lo / GRID


def plan(rows: DataFrame, *, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(name, quota, whole, rest, total): whole passes over each source and the tokens of the last one.

    A row per source, made on the driver, so it is small enough to broadcast.
    """
    got = rows.groupBy("name").agg(F.sum("n_tokens").alias("total")).collect()
    totals = {r["name"]: r["total"] for r in got if r["total"]}
    parts = [(r["name"], 0, 1, 0, 0) for r in got if not r["total"]]
    if totals:
        alpha = bisect_alpha(totals, max_repeats=max_repeats, target_entropy=target_entropy, budget=budget)
        for name, times in repeats(totals, alpha, budget).items():
            quota = math.floor(totals[name] * times + 1e-6)
            parts.append((name, quota, quota // totals[name], quota % totals[name], totals[name]))
    return rows.sparkSession.createDataFrame(parts, "name string, quota long, whole long, rest long, total long").coalesce(1)


def stops(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """(name, stop): the least key of a source's last pass that no longer fits; no row if all fit."""
    last = rows.select("name", order_key(F.col("whole")).alias("key"), "n_tokens", "rest")
    placed = running(last, "name", ["key"], "n_tokens")
    return placed.where(F.col("start") + F.col("n_tokens") > F.col("rest")).groupBy("name").agg(F.min("key").alias("stop"))


def staged_rows(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    rows = stage(docs.select("doc_id", "source", named().alias("name"), tokens().alias("n_tokens")), "slim")
    shares = stage(plan(rows, **how), "shares")
    return rows.join(F.broadcast(shares), "name"), shares


def schedule(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, pass, block, n_tokens, start): every use of every document, whole mixture."""
    rows, shares = staged_rows(docs, **how)
    stop = stops(rows, shares)
    uses = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole")))).withColumn("key", order_key(F.col("pass"))).join(F.broadcast(stop), "name", "left")
    uses = uses.where((F.col("pass") < F.col("whole")) | ((F.col("rest") > 0) & F.coalesce(F.col("key") < F.col("stop"), F.lit(True))))
    placed = running(uses, "name", ["pass", "key"], "n_tokens")
    block = F.when(F.col("quota") > 0, F.least(F.expr(f"start * {BLOCKS} div greatest(quota, 1)"), F.lit(BLOCKS - 1))).otherwise(0)
    return placed.select("doc_id", "source", F.col("pass").cast("int").alias("pass"), block.cast("int").alias("block"), "n_tokens", "start")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as often as the mixture uses it; columns stay as they are."""
    rows, shares = staged_rows(docs, **how)
    name, whole, rest, stop, use = fresh(docs, "mix_name", "mix_whole", "mix_rest", "mix_stop", "mix_use")
    limits = shares.join(stops(rows, shares), "name", "left").select(F.col("name").alias(name), F.col("whole").alias(whole), F.col("rest").alias(rest), F.col("stop").alias(stop))
    keyed = docs.join(F.broadcast(limits), named() == F.col(name))
    again = (F.col(rest) > 0) & F.coalesce(order_key(F.col(whole)) < F.col(stop), F.lit(True))
    times = (F.col(whole) + again.cast("long")).cast("int")
    return keyed.withColumn(use, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH rows_ AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, row_number() OVER () AS uid
  FROM documents),
totals AS (SELECT name, CAST(sum(n_tokens) AS BIGINT) AS total FROM rows_ GROUP BY name),
ends AS (SELECT max(total)::DOUBLE AS top, min(total)::DOUBLE AS low FROM totals WHERE total > 0),
temperature AS (SELECT CASE WHEN top = low THEN 0 ELSE greatest(0, ceil((1 - ln({MAX_REPEATS}) / ln(top / low)) * {GRID})) / {GRID} END AS alpha, top FROM ends),
shares AS (
  SELECT name, total, CASE WHEN total > 0 THEN CAST(floor(total * pow(top / total, 1 - alpha) + 1e-6) AS BIGINT) ELSE 0 END AS quota
  FROM totals, temperature),
parts AS (SELECT *, CASE WHEN total > 0 THEN quota // total ELSE 1 END AS whole, CASE WHEN total > 0 THEN quota % total ELSE 0 END AS rest FROM shares),
uses AS (
  SELECT doc_id, source, uid, n_tokens, quota, whole, rest, name, pass, md5('{SEED}:' || pass || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM (SELECT *, unnest(range(0, whole + 1)) AS pass FROM rows_ JOIN parts USING (name))),
cuts AS (
  SELECT name, min(key) AS stop FROM (
    SELECT name, key, rest, sum(n_tokens) OVER (PARTITION BY name ORDER BY key, uid ROWS UNBOUNDED PRECEDING) AS upto FROM uses WHERE pass = whole)
  WHERE upto > rest GROUP BY name),
used AS (SELECT u.* FROM uses u LEFT JOIN cuts c USING (name) WHERE pass < whole OR (rest > 0 AND coalesce(key < stop, true))),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY name ORDER BY pass, key, uid ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM used)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, CAST(CASE WHEN quota > 0 THEN least(start * {BLOCKS} // greatest(quota, 1), {BLOCKS - 1}) ELSE 0 END AS INTEGER) AS block,
       n_tokens, CAST(start AS BIGINT) AS start
FROM placed
"""
