"""Queries of the duplicate photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions import scalars as S
from rubrica.operators import duplicates, rules, score
from rubrica.plans import bind
from rubrica.plans.bind import NEAR
from rubrica.plans.queries import GREEDY, IMG, ORACLES, QUERIES, c
from rubrica.plans.staging import stage


def images(name: str, oracle: str, base: str = IMG):
    """Register fn(images); the oracle reads i."""

    def keep(fn):
        QUERIES[name] = lambda spark, d: fn(bind.images(spark, d))
        ORACLES[name] = f"{base}{'' if oracle.startswith(',') else ' '}{oracle}"
        return fn

    return keep


TARGET = "(SELECT min(file) FROM i WHERE phash IS NOT NULL)"


def target(d: DataFrame):
    return d.where("phash is not null").orderBy("file").select("sha256", "phash").first()


@images("hamming", f"SELECT file, CAST(hamming(phash, (SELECT phash FROM i WHERE file = {TARGET})) AS INT) AS distance FROM i")
def hamming(d: DataFrame) -> DataFrame:
    return d.select("file", S.hamming(c("phash"), F.lit(target(d)["phash"])).alias("distance"))


HOLDER = "CASE WHEN row_number() OVER w > 1 THEN first(submission) OVER w END AS holder"


@images("dup_exact", f"SELECT file, {HOLDER} FROM i WINDOW w AS (PARTITION BY sha256 ORDER BY ord, pos)")
def dup_exact(d: DataFrame) -> DataFrame:
    return duplicates.exact(d).select("file", "holder")


@images("dup_directory", f"SELECT file, {HOLDER} FROM i WINDOW w AS (PARTITION BY key, sha256 ORDER BY ord, pos)")
def dup_directory(d: DataFrame) -> DataFrame:
    return duplicates.in_directory(d).select("file", "holder")


PAIRS = f"pairs AS (SELECT a.ord AS a_ord, a.pos AS a_pos, b.ord AS b_ord, b.pos AS b_pos, CAST(hamming(a.phash, b.phash) AS INT) AS distance FROM i a JOIN i b ON (a.ord, a.pos) < (b.ord, b.pos) AND a.phash <> b.phash AND hamming(a.phash, b.phash) <= {NEAR})"


@images("dup_near", f", {PAIRS} SELECT * FROM pairs")
def dup_near(d: DataFrame) -> DataFrame:
    """Only photos with a hash are staged, by what the pairs tell of them."""
    return duplicates.near_pairs(stage(d.where("phash is not null").select("ord", "pos", "phash"), "photos"), NEAR).select("a_ord", "a_pos", "b_ord", "b_pos", "distance")


@images("dup_target_scan", f", x AS (SELECT sha256 AS s, phash AS p FROM i WHERE file = {TARGET}) SELECT file, CASE WHEN sha256 = s THEN 'exact' WHEN hamming(phash, p) <= {NEAR} THEN 'similar' END AS match FROM i, x")
def dup_target_scan(d: DataFrame) -> DataFrame:
    """The target is found within the query, which reads what both sides need once."""
    t = d.where("phash is not null").agg(F.min(F.struct("file", "sha256", "phash")).alias("target")).where("target is not null")
    both = d.select("file", "sha256", "phash").crossJoin(F.broadcast(t))
    return duplicates.against_target(both, c("target.sha256"), c("target.phash"), NEAR).select("file", "match")


@images("dup_greedy", "SELECT DISTINCT i.submission, i.ord, dups.id IS NOT NULL AS flagged FROM i LEFT JOIN dups ON dups.id = i.ord", GREEDY)
def dup_greedy(d: DataFrame) -> DataFrame:
    return duplicates.greedy(stage(d, "photos"), NEAR)


@images("rule_duplicates", "SELECT i.submission, CASE WHEN any_value(said) IS NULL THEN 15 ELSE 0 END AS points, coalesce('Duplicate Check: ' || any_value(said), '') AS message FROM i LEFT JOIN dups ON dups.id = i.ord GROUP BY i.submission", GREEDY)
def rule_duplicates(d: DataFrame) -> DataFrame:
    d = stage(d, "photos")
    found = duplicates.greedy_messages(d, NEAR)
    rows = d.select("submission", "ord").distinct().join(found.drop("submission"), "ord", "left")
    o = rules.duplicate_outcome(c("messages"))
    return score.held(rows, [o]).select("submission", score.total([o]).alias("points"), c("why_15").alias("message"))


@images("first_image", "SELECT submission, arg_min(sha256, pos) AS sha256 FROM i GROUP BY submission")
def first_image(d: DataFrame) -> DataFrame:
    return duplicates.first_images(d)

