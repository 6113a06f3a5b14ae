"""Queries of the sources, the mapping, the levels and the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions import scalars as S
from rubrica.operators import levels, mapping, rules, score
from rubrica.plans import bind
from rubrica.plans.queries import c, documents, query, sub
from rubrica.plans.staging import shared_dir, stage
from rubrica.sources import assets, readers

COLUMNS = {"title": "m_title", "objectives": "m_objectives", "learning_outcomes": "m_outcomes", "theme": "m_theme", "event_type": "m_type", "event_date": "m_date", "year_type": "m_year_type", "event_mode": "m_mode"}


@sub("map_columns", "SELECT id, title, Objective AS objectives, benefit_learning AS learning_outcomes, event_theme AS theme, trim(event_type) AS event_type, from_date AS event_date, financial_year AS year_type, session_type AS event_mode FROM u")
def map_columns(d: DataFrame) -> DataFrame:
    return d.select("id", *[c(v).alias(k) for k, v in COLUMNS.items()])


@sub("map_duration", "SELECT id, duration FROM u")
def map_duration(d: DataFrame) -> DataFrame:
    return d.select("id", c("m_duration").alias("duration"))


@sub("participants_total", "SELECT id, CAST(parts AS INT) AS participants FROM u")
def participants_total(d: DataFrame) -> DataFrame:
    return d.select("id", c("m_participants").cast("int").alias("participants"))


@sub("derive_level", "SELECT id, CAST(lvl AS INT) AS level FROM u")
def derive_level(d: DataFrame) -> DataFrame:
    return d.select("id", c("m_level").alias("level"))


@sub("level_range_join", "SELECT id, l.level FROM u LEFT JOIN (VALUES (1, 2.0, 4.0), (2, 5.0, 8.0), (3, 9.0, 18.0), (4, 19.0, 1e308)) l(level, lo, hi) ON h BETWEEN lo AND hi")
def level_range_join(d: DataFrame) -> DataFrame:
    return levels.level_join(d, "hours").select("id", "level")


@sub("level_by_type", "SELECT id, CASE WHEN id % 8 = 6 AND h BETWEEN 2 AND 4 THEN 1 WHEN id % 8 = 1 AND h BETWEEN 5 AND 8 THEN 2 WHEN id % 8 = 1 AND h BETWEEN 9 AND 18 THEN 3 WHEN id % 8 = 1 AND h >= 19 THEN 4 END AS level FROM u")
def level_by_type(d: DataFrame) -> DataFrame:
    return d.select("id", levels.level_by_type(c("m_type"), c("hours")).alias("level"))


@sub("level_duration_match", "SELECT id, coalesce(lvl = event_driven, false) AS matches FROM u")
def level_duration_match(d: DataFrame) -> DataFrame:
    return d.select("id", levels.in_level(c("driven"), c("hours")).alias("matches"))


def in_units():
    unit = F.when(c("id") % 3 == 0, " Hours 30 Minutes").when(c("id") % 3 == 1, "hrs").otherwise(" mins")
    return F.concat(F.floor("raw.activity_duration").cast("string"), unit)


@sub("parse_duration", "SELECT id, floor(h) AS hours FROM u")
def parse_duration(d: DataFrame) -> DataFrame:
    return d.select("id", levels.parse_hours(in_units()).alias("hours"))


@sub("parse_duration_minutes", "SELECT id, CASE WHEN id % 3 = 1 THEN floor(h) ELSE floor(h) / 60 END AS hours FROM u")
def parse_duration_minutes(d: DataFrame) -> DataFrame:
    return d.select("id", levels.parse_hours_by_unit(in_units()).alias("hours"))


YEAR = "CAST(right(from_date, 4) AS INT)"


@sub("academic_year_norm", f"SELECT id, CASE WHEN acadmic_year IS NULL THEN 'nan' ELSE CASE id % 5 WHEN 2 THEN '' WHEN 3 THEN '24' WHEN 4 THEN '2024-25' ELSE {YEAR} || '-' || right(CAST({YEAR} + 1 AS VARCHAR), 2) END END AS academic_year FROM u")
def academic_year_norm(d: DataFrame) -> DataFrame:
    return d.select("id", c("m_year").alias("academic_year"))


@sub("resolve_path", "SELECT id, CASE id % 13 WHEN 0 THEN '' WHEN 1 THEN 'https://files.example.org/' || id ELSE base || '/reports/' || id || '.pdf' END AS pdf_path FROM u")
def resolve_path(d: DataFrame) -> DataFrame:
    return d.select("id", c("m_pdf_path").alias("pdf_path"))


PATHS = "list_transform(files, lambda f: base || '/photos/' || f || '.jpg')"


@sub("image_paths", f"SELECT id, array_to_string({PATHS}, ',') AS image_paths FROM u")
def image_paths(d: DataFrame) -> DataFrame:
    return d.select("id", c("m_image_paths").alias("image_paths"))


@sub("split_paths", f"SELECT id, len(files) AS n, {PATHS}[1] AS first FROM u")
def split_paths(d: DataFrame) -> DataFrame:
    return d.withColumn("p", mapping.split_paths(c("m_image_paths"))).select("id", F.size("p").cast("long").alias("n"), F.try_element_at("p", F.lit(1)).alias("first"))


@sub("submission_id", "SELECT id, CAST(id AS VARCHAR) AS sid, directory FROM u")
def submission_id(d: DataFrame) -> DataFrame:
    return d.select("id", "sid", "directory")


@sub("event_driven_int", "SELECT id, CASE WHEN id % 41 = 6 THEN NULL ELSE CAST(id % 6 AS INT) END AS driven, canonical FROM u")
def event_driven_int(d: DataFrame) -> DataFrame:
    """event_driven as a file gives it, in three types: a number, a text and a text of a float, which is no int()."""
    texts = d.select("id", F.when(c("id") % 2 == 0, c("raw.event_driven").cast("string")).otherwise(F.concat(F.lit(" "), c("raw.event_driven").cast("string"))).alias("event_driven"))
    as_text = mapping.mapped(texts).select(c("raw.id").alias("id"), c("driven").alias("driven"))
    return d.select("id", "canonical").join(as_text, "id").select("id", "driven", "canonical")


@sub("level_backfill", "SELECT id, CAST(CASE WHEN id % 2 = 0 AND lvl = event_driven THEN NULL ELSE lvl END AS INT) AS level FROM u WHERE lvl IS NOT NULL AND (id % 2 = 1 OR event_driven BETWEEN 1 AND 4)")
def level_backfill(d: DataFrame) -> DataFrame:
    """The level that rule 2 writes back: where none is given, or one that the hours do not fit."""
    given = F.when(c("id") % 2 == 0, c("driven").cast("string")).otherwise("")
    chosen = d.where(c("m_level").isNotNull() & ((c("id") % 2 == 1) | c("driven").between(1, 4)))
    return chosen.select("id", rules.level_rule(c("m_duration"), levels.parse_hours(c("m_duration")), given)["new_level"].alias("level"))


@sub("safe_filename", "SELECT id, regexp_replace(trim(event_type), '[^\\p{L}\\p{N}_-]', '_', 'g') AS stem FROM u")
def safe_filename(d: DataFrame) -> DataFrame:
    return d.select("id", S.safe_stem(c("m_type")).alias("stem"))


@sub("score_coercion", "SELECT id, CAST(CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE coalesce(trunc(h), 0) END AS INT) AS score FROM u")
def score_coercion(d: DataFrame) -> DataFrame:
    text = F.when(c("id") % 5 == 0, "x").when(c("id") % 5 == 1, "nan").when(c("id") % 5 == 2, "1e12").otherwise(c("raw.activity_duration").cast("string"))
    return d.select("id", score.coerced(text).alias("score"))


@documents("pdf_title_fallback", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Meta' WHEN length(trim(str_split(text, chr(10))[1])) BETWEEN 6 AND 199 THEN trim(str_split(text, chr(10))[1]) END AS title FROM documents")
def pdf_title_fallback(d: DataFrame) -> DataFrame:
    return d.select("doc_id", S.pdf_title(F.create_map(F.lit("Title"), F.when(c("doc_id") % 4 == 0, "Meta").otherwise("")), c("text")).alias("title"))


@documents("base64_content", "SELECT doc_id, to_base64(encode(text)) AS content FROM documents")
def base64_content(d: DataFrame) -> DataFrame:
    return d.select("doc_id", S.base64_text(c("text").cast("binary")).alias("content"))


@query("timestamp_format", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    return bind.load(spark, d, "events").select("event_id", S.stamp(c("ts")).alias("stamp"))


@query("scan_csv", "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_name || ', \"quoted\"' || chr(10) || 'line' END AS remark, n_nationkey / 4.0 AS share FROM nation")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    """A CSV written from nation, with quotes, line breaks, missing cells and numbers, and read by the CSV source."""
    remark = F.when(c("n_nationkey") % 4 == 0, "N/A").otherwise(F.concat("n_name", F.lit(', "quoted"\nline')))
    rows = bind.load(spark, d, "nation").select("*", remark.alias("remark"), (c("n_nationkey") / 4).alias("share"))
    path = f"{shared_dir(spark)}/scan-csv-{spark.sparkContext.applicationId}-{abs(hash(d)) % 10**8}"
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    got = readers.read_csv(spark, path)
    return got.select(c("n_nationkey").cast("int"), "n_name", c("n_regionkey").cast("int"), "remark", "share")


@query("scan_json_rows", "SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a JSON object, read by the JSON source as a request body would be."""
    body = bind.load(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value", F.from_json("props", "k long")["k"].alias("k"))).alias("value"))
    return readers.read_json_lines(body, "event_id long, event_type string, value double, k long")


@query("stale_files", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    files = bind.load(spark, d, "events").select("event_id", c("ts").cast("timestamp").alias("modificationTime"))
    return readers.stale(files, F.lit(files.agg(F.max("modificationTime")).first()[0])).select("event_id")


@documents("file_stats", "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) / 1048576, 2) AS mb FROM documents GROUP BY source")
def file_stats(d: DataFrame) -> DataFrame:
    return readers.folder_stats(d.select("source", F.octet_length("text").alias("length")), "source")


@documents("content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, substr(sha256(text), 1, 16) AS short FROM documents")
def content_hash(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.substring(F.sha2("text", 256), 1, 16).alias("short"))


@query(
    "perceptual_hash",
    """
WITH pixel AS (SELECT vec_id, (n - 1) // 8 AS r, (n - 1) % 8 AS q, embedding[n] AS g FROM embeddings, range(1, 65) x(n)),
wave AS (SELECT k, q, sum(cos(pi() * (2 * i + 1) * k / 64)) AS w FROM range(0, 8) a(k), range(0, 8) b(q), range(0, 32) d(i) WHERE i // 4 = q GROUP BY k, q),
term AS (SELECT vec_id, u.k AS ku, v.k AS kv, sum(CAST(g AS DOUBLE) * u.w * v.w) AS x FROM pixel JOIN wave u ON u.q = r JOIN wave v ON v.q = pixel.q GROUP BY ALL),
bit AS (SELECT vec_id, ku * 8 + kv AS n, x > median(x) OVER (PARTITION BY vec_id) AS b FROM term)
SELECT vec_id, string_agg(h, '' ORDER BY nibble) AS phash FROM (
  SELECT vec_id, n // 4 AS nibble, printf('%x', CAST(sum(CASE WHEN b THEN 8 >> (n % 4) ELSE 0 END) AS INT)) AS h FROM bit GROUP BY vec_id, n // 4) GROUP BY vec_id""",
)
def perceptual_hash(spark: SparkSession, d: str) -> DataFrame:
    """The embedding as a picture of 8 by 8 pixels."""
    return bind.load(spark, d, "embeddings").select("vec_id", assets.phash_of(c("embedding")).alias("phash"))


CANON = """CASE id % 8 WHEN 0 THEN 'Level 1 - Expert Talk' WHEN 1 THEN 'Workshop' WHEN 2 THEN 'Level 2 - Seminar' WHEN 3 THEN '' WHEN 4 THEN 'Level'
  WHEN 5 THEN 'Level 3 - Conference - B' WHEN 6 THEN 'Expert Talk' ELSE 'Level x - Level x Level y' END || CASE WHEN event_theme <> '' THEN ' - on ' || event_theme ELSE '' END"""
EXPECT = f"CASE WHEN canonical THEN {CANON} ELSE title END"
SEEN = "CASE WHEN title = '' THEN 'Not provided' ELSE title END"


def misfit(reason: str) -> str:
    return f"""CASE WHEN canonical THEN 'Content does not match canonical event title. Expected: "' || ({EXPECT}) || '". Observed: "' || {SEEN} || '". Reason: {reason}'
  ELSE 'Title/Objectives/Learning do not align with theme: ' || ({EXPECT}) || '. Observed: "' || {SEEN} || '". Reason: {reason}' END"""


@sub("canonical_title", f"SELECT id, {CANON} AS title FROM u")
def canonical_title(d: DataFrame) -> DataFrame:
    return d.select("id", S.canonical_title(c("m_type"), c("m_theme")).alias("title"))


def expected(d: DataFrame):
    return S.expected_title(c("canonical"), c("m_type"), c("m_theme"), c("m_title"))


@sub("expected_title", f"SELECT id, {EXPECT} AS title FROM u")
def expected_title(d: DataFrame) -> DataFrame:
    return d.select("id", expected(d).alias("title"))


@sub("title_message", f"SELECT id, {misfit('not aligned')} AS message FROM u")
def title_message(d: DataFrame) -> DataFrame:
    return d.select("id", S.title_message(c("canonical"), expected(d), c("m_title"), F.lit("not aligned")).alias("message"))


@sub("parse_date", "SELECT id, strftime(make_date(CAST(right(from_date, 4) AS BIGINT), CAST(str_split(from_date, '/')[1] AS BIGINT), CAST(str_split(from_date, '/')[2] AS BIGINT)), '%Y-%m-%d') AS d FROM u")
def parse_date(d: DataFrame) -> DataFrame:
    """Every seventh row in each of the formats; day before month only where the day tells it."""
    day = S.parse_date(c("m_date"))
    styles = ["yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy", "M/d/yyyy", "yyyy/M/d", "d MMMM yyyy", "MMMM d, yyyy"]
    text = F
    for i, style in enumerate(styles):
        text = text.when(c("id") % 7 == i, F.date_format(day, style))
    return stage(d.select("id", text.alias("text")), "dates").select("id", S.parse_date(c("text")).cast("string").alias("d"))


@query("fiscal_year", "SELECT o_orderkey AS id, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS INT) AS fy FROM orders")
def fiscal_year(spark: SparkSession, d: str) -> DataFrame:
    return bind.load(spark, d, "orders").select(c("o_orderkey").alias("id"), S.fiscal_year(c("o_orderdate")).alias("fy"))


NAMES = "|".join(f"(?:{S.unicode_pattern(p, r'(?:^|[^\p{L}\p{N}_])')})" for p in S.NAME_PATTERNS)


@documents("name_pattern", f"SELECT doc_id, regexp_matches(text, '{NAMES}') AS named FROM documents")
def name_pattern(d: DataFrame) -> DataFrame:
    return d.select("doc_id", S.has_name(c("text")).alias("named"))


@documents("token_estimate", "SELECT doc_id, CAST(length(text) // 4 + 1000 * (doc_id % 2) AS BIGINT) AS tokens FROM documents")
def token_estimate(d: DataFrame) -> DataFrame:
    return d.select("doc_id", S.token_estimate(c("text"), c("doc_id") % 2).cast("long").alias("tokens"))


@documents("text_prefix", "SELECT doc_id, substr(text, 1, 4000) AS prefix FROM documents")
def text_prefix(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.substring("text", 1, 4000).alias("prefix"))


@documents("prompt_cache_key", "SELECT doc_id, sha256('model|' || substr(text, 1, 4000) || '|' || substr(sha256(text), 1, 16)) AS key FROM documents")
def prompt_cache_key(d: DataFrame) -> DataFrame:
    return d.select("doc_id", S.cache_key(F.lit("model"), F.substring("text", 1, 4000), F.substring(F.sha2("text", 256), 1, 16)).alias("key"))

