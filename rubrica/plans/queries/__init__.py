"""Queries of the engine by name, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.plans import bind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col

# --- SQL over the bound rows, written apart from the engine's expressions ---
DAY = "https://storage.example.org/container"
HOURS = "CASE WHEN h BETWEEN 2 AND 4 THEN 1 WHEN h BETWEEN 5 AND 8 THEN 2 WHEN h BETWEEN 9 AND 18 THEN 3 WHEN h >= 19 THEN 4 END"
SUB = f"""WITH s AS ({bind.DUCK_SUBMISSIONS}),
t AS (SELECT *, activity_duration AS h, {HOURS.replace("h ", "activity_duration ")} AS lvl,
  coalesce(student_participants + faculty_participants, 0) AS parts, coalesce(trim(activity_name), 'nan') AS title,
  coalesce(CAST(activity_duration AS VARCHAR), 'nan') || 'h' AS duration, coalesce(event_driven IN (1, 2, 4), false) AS canonical,
  coalesce(CAST(event_driven AS VARCHAR), 'nan') || '_' || coalesce(acadmic_year, 'nan') AS directory, activity_name IS NULL AS broken,
  CASE WHEN event_driven IN (3, 4) THEN '{DAY}/uploads/institutes' ELSE '{DAY}' END AS base,
  CASE WHEN id % 17 = 0 THEN [] WHEN id % 3 = 0 THEN [2 * id] ELSE [2 * id, 2 * id + 1] END AS files FROM s),
u AS (SELECT *, len(list_filter(files, lambda f: f % 23 <> 5)) AS n_images, report_id IS NOT NULL AS has_pdf FROM t)"""
# What the rules take from a report: whether it is empty, and whether it has one of the words.
BODY = f"LEFT JOIN (SELECT report_id, text = '' AS blank, regexp_matches(lower(text), '{'|'.join(bind.WORDS)}') AS found FROM ({bind.DUCK_REPORTS}) d) reports USING (report_id)"
IMG = f"""{SUB},
f AS ({bind.DUCK_FILES}),
i AS (SELECT id AS submission, id AS ord, CAST(pos AS INT) AS pos, directory AS key, base || '/photos/' || x.file || '.jpg' AS path, x.file, coalesce(f.sha256, sha256('photo ' || x.file)) AS sha256, f.phash
  FROM (SELECT id, directory, base, unnest(files) AS file, generate_subscripts(files, 1) - 1 AS pos FROM u WHERE NOT broken) x LEFT JOIN f ON f.file = x.file WHERE NOT (x.file {bind.MISSING}))"""
# The sequential scan, one photo a step; photos without a hash are all different and repeat nothing.
SCAN = f"""g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord, pos) AS n, * FROM i WHERE phash IS NOT NULL),
scan AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS ord, false AS flagged, CAST('' AS VARCHAR) AS said,
    CAST([] AS STRUCT(sha VARCHAR, hash VARCHAR, key VARCHAR, who BIGINT, path VARCHAR)[]) AS seen
  UNION ALL
  SELECT n, ord, flagged, said, CASE WHEN flagged THEN seen ELSE list_append(seen, {{'sha': sha256, 'hash': phash, 'key': key, 'who': submission, 'path': path}}) END
  FROM (SELECT *, held OR said <> '' AS flagged FROM (SELECT *, CASE WHEN x IS NOT NULL THEN 'Image identical to submission ' || x.who || ' (SHA256 match)' ELSE concat_ws('; ',
      CASE WHEN p IS NOT NULL THEN printf('Image similar to file in directory (pHash match (similarity score: %.1f)): ', CAST(hamming(p.hash, phash) AS DOUBLE)) || p.path END,
      CASE WHEN q IS NOT NULL THEN 'Image similar to submission ' || q.who || ' (pHash distance: ' || hamming(q.hash, phash) || ', threshold: {bind.NEAR})' END) END AS said
    FROM (SELECT g.*, scan.seen, scan.ord = g.ord AND scan.flagged AS held,
        list_filter(scan.seen, lambda e: e.sha = g.sha256)[1] AS x,
        list_filter(scan.seen, lambda e: e.key = g.key AND hamming(e.hash, g.phash) <= {bind.NEAR})[1] AS p,
        list_filter(scan.seen, lambda e: e.hash <> g.phash AND hamming(e.hash, g.phash) <= {bind.NEAR})[1] AS q
      FROM scan JOIN g ON g.n = scan.n + 1)))),
dups AS (SELECT ord AS id, string_agg(said, '; ' ORDER BY n) AS said FROM scan WHERE said <> '' GROUP BY ord)"""
GREEDY = f"{IMG}, {SCAN}".replace("WITH s AS", "WITH RECURSIVE s AS", 1)


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir)."""

    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def sub(name: str, oracle: str | None = None):
    """Register fn(mapped submissions); the oracle reads u, their SQL twin."""

    def keep(fn):
        QUERIES[name] = lambda spark, d: fn(bind.standard(spark, d))
        if oracle:
            ORACLES[name] = f"{SUB}{'' if oracle.startswith(',') else ' '}{oracle}"
        return fn

    return keep


def reported(name: str, oracle: str, words: list[str] = bind.WORDS):
    """As sub(), with the features of the reports; the oracle joins BODY where it needs their text."""

    def keep(fn):
        QUERIES[name] = lambda spark, d: fn(bind.with_reports(bind.standard(spark, d), spark, d, words))
        ORACLES[name] = f"{SUB}{'' if oracle.startswith(',') else ' '}{oracle}"
        return fn

    return keep


def documents(name: str, oracle: str):
    """Register fn(documents)."""

    def keep(fn):
        QUERIES[name] = lambda spark, d: fn(bind.load(spark, d, "documents"))
        ORACLES[name] = oracle
        return fn

    return keep
