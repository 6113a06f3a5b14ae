"""Submissions, reports, photos and answers bound to the star-schema tables.

One SQL text serves Spark and DuckDB for the raw rows, so both engines see the same input. Everything derived from them is computed by the engine on
the one side, and by SQL of its own (plans/queries) on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.operators.mapping import mapped, split_paths
from rubrica.plans import pipeline
from rubrica.plans.staging import stage

#: The least distance between the hashes bound here is 9, so 5 would find no pair.
NEAR = 11
WORDS = ["tion", "and"]  # words that the bound texts hold; the rubric's own lists are the defaults of the operators

SUBMISSIONS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 = 6 THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END AS event_driven,
  CASE WHEN o_orderkey % 29 = 7 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(' ', o_orderpriority, ' talk ') END AS activity_name,
  concat('objective ', CAST(o_custkey % 7 AS STRING)) AS Objective, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE concat('outcome ', CAST(o_custkey % 5 AS STRING)) END AS benefit_learning,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Theme ', o_orderpriority) END AS event_theme,
  CASE o_orderkey % 8 WHEN 0 THEN 'Level 1 - Expert Talk' WHEN 1 THEN 'Workshop' WHEN 2 THEN 'Level 2 - Seminar' WHEN 3 THEN ''
    WHEN 4 THEN 'Level' WHEN 5 THEN 'Level3 -  Conference - B ' WHEN 6 THEN 'Expert Talk' ELSE 'pre-Level x Level y' END AS event_type,
  concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING)) AS from_date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Financial' ELSE concat(CAST(year(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) + 1 AS STRING)) END AS financial_year,
  CASE WHEN o_orderkey % 43 = 8 THEN NULL ELSE CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) + 1 AS STRING))
    WHEN 1 THEN CAST(year(o_orderdate) AS STRING) WHEN 2 THEN 'abcd' WHEN 3 THEN '24' ELSE ' 2024-25 ' END END AS acadmic_year,
  CASE o_orderstatus WHEN 'F' THEN 'Offline' WHEN 'O' THEN 'Online' ELSE o_orderstatus END AS session_type,
  CASE WHEN o_orderkey % 31 = 3 THEN NULL ELSE hours END AS activity_duration,
  CASE WHEN o_orderkey % 37 = 5 THEN NULL ELSE CAST(o_custkey % 20 AS INT) END AS student_participants, l_linenumber AS faculty_participants,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 13 = 1 THEN concat('https://files.example.org/', CAST(o_orderkey AS STRING)) ELSE concat('/reports/', CAST(o_orderkey AS STRING), '.pdf') END AS report,
  CASE WHEN o_orderkey % 17 = 0 THEN ' N/A ' ELSE concat('photos/', CAST(2 * o_orderkey AS STRING), '.jpg') END AS photo1,
  CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 3 = 0 THEN '0' ELSE concat('/photos/', CAST(2 * o_orderkey + 1 AS STRING), '.jpg') END AS photo2,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN CAST(-1 AS BIGINT) ELSE o_orderkey % n_docs END AS report_id,
  CASE WHEN o_orderkey % 3 = 1 THEN 'NO' ELSE 'Yes.' END AS theme_answer,
  concat('TITLE_MATCH: ', CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'NO' END, chr(10), 'EXPERT_DETAILS: ', CASE WHEN o_orderkey % 3 = 0 THEN 'YES' ELSE 'NO' END, chr(10),
    'LEARNING_OUTCOMES_ALIGN: ', CASE WHEN o_orderkey % 5 = 0 THEN 'YES' ELSE 'NO' END, chr(10), 'OBJECTIVES_MATCH: ', CASE WHEN o_orderkey % 7 = 0 THEN 'YES' ELSE 'NO' END, chr(10),
    CASE WHEN o_orderkey % 8 = 0 THEN 'REASONING: none: given' ELSE 'PARTICIPANTS_VALID: YES' END) AS pdf_answer,
  concat('HAS_BANNER: ', CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END, chr(10), 'IS_REAL_EVENT: ', CASE WHEN o_orderkey % 3 = 0 THEN 'YES' ELSE 'NO' END, chr(10),
    'MODE_MATCHES: ', CASE WHEN o_orderkey % 5 = 0 THEN 'YES' ELSE 'NO' END, chr(10), 'PARTICIPANT_COUNT: ', CASE WHEN o_orderkey % 4 = 0 THEN '~20' ELSE CAST(o_orderkey % 40 AS STRING) END, chr(10),
    'HAS_15_PLUS_PARTICIPANTS: ', CASE WHEN o_orderkey % 7 = 0 THEN 'YES' ELSE 'NO' END) AS image_answer
FROM {orders} o
JOIN (SELECT l_orderkey, l_linenumber, l_quantity / 2.0 AS hours, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM {lineitem}) l
  ON l_orderkey = o_orderkey AND rn = 1
CROSS JOIN (SELECT count(*) AS n_docs FROM {documents}) k
"""
REPORTS = "SELECT doc_id AS report_id, text FROM {documents} UNION ALL SELECT CAST(-1 AS BIGINT) AS report_id, '' AS text"
#: The hash of file k is that of vector k; two of twenty files share the hash of an earlier one, of their own submission or of one 30 before it.
VECTOR = "CASE WHEN doc_id % 20 = 1 THEN doc_id - 1 WHEN doc_id % 20 = 8 AND doc_id >= 60 THEN doc_id - 60 ELSE doc_id END % n_vecs"
SPARK_FILES = f"""
SELECT doc_id AS file, sha2(text, 256) AS sha256, p.phash FROM {{documents}} CROSS JOIN (SELECT count(*) AS n_vecs FROM {{embeddings}}) k JOIN
  (SELECT vec_id, array_join(transform(sequence(0, 15), i -> lower(hex(
     int(embedding[4 * i] > 0) * 8 + int(embedding[4 * i + 1] > 0) * 4 + int(embedding[4 * i + 2] > 0) * 2 + int(embedding[4 * i + 3] > 0)))), '') AS phash FROM {{embeddings}}) p
  ON p.vec_id = {VECTOR}"""
DUCK_FILES = f"""
SELECT doc_id AS file, sha256(text) AS sha256, p.phash FROM documents CROSS JOIN (SELECT count(*) AS n_vecs FROM embeddings) k JOIN
  (SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda i: lower(printf('%x', CAST(
     CAST(embedding[4 * i + 1] > 0 AS INT) * 8 + CAST(embedding[4 * i + 2] > 0 AS INT) * 4 + CAST(embedding[4 * i + 3] > 0 AS INT) * 2 + CAST(embedding[4 * i + 4] > 0 AS INT) AS INT)))), '') AS phash FROM embeddings) p
  ON p.vec_id = {VECTOR}"""
DUCK_SUBMISSIONS = SUBMISSIONS.format(orders="orders", lineitem="lineitem", documents="documents")
DUCK_REPORTS = REPORTS.format(documents="documents")
#: One file in 23 is missing.
MISSING = "% 23 = 5"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows. Orders that compress well pass for small by the size of their files, and the driver would hold them all to broadcast them: the join is hinted to merge."""
    tables = {n: load(spark, sf_dir, n) for n in ("orders", "lineitem", "documents")}
    return spark.sql(SUBMISSIONS, **{**tables, "orders": tables["orders"].hint("merge")})


def file_of(path):
    """The number of a photo's file, from its path."""
    return F.regexp_extract(path, r"(\d+)\.jpg$", 1).try_cast("bigint")


def standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped rows with their id, answers and number of photos whose file exists."""
    rows = submissions(spark, sf_dir)
    df = mapped(rows.withColumn("row_id", F.col("id")), EngineConfig(), keep=("row_id",)).withColumnRenamed("row_id", "id")  # a plain column, by which the rows already lie
    carried = {n: F.col(f"raw.{n}") for n in ("report_id", "theme_answer", "pdf_answer", "image_answer")}
    return df.withColumns({**carried, "n_images": F.size(F.filter(split_paths(F.col("m_image_paths")), lambda p: file_of(p) % 23 != 5))})


def with_reports(df: DataFrame, spark: SparkSession, sf_dir: str, words: list[str] = WORDS) -> DataFrame:
    reports = spark.sql(REPORTS, documents=load(spark, sf_dir, "documents"))
    return pipeline.with_reports(df, pipeline.report_features(reports, words=words), "report_id")


def photos_of(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission, ord, pos, key, path, file, has_geotag, sha256, phash) of the photos that exist; files beyond the documents are all different."""
    files = spark.sql(SPARK_FILES, **{n: load(spark, sf_dir, n) for n in ("documents", "embeddings")})
    named = pipeline.photos(df, "id").withColumn("submission", F.col("ord")).withColumn("file", file_of(F.col("path"))).where(f"not (file {MISSING})")
    own = F.sha2(F.concat(F.lit("photo "), F.col("file").cast("string")), 256)
    return named.join(files, "file", "left").withColumns({"sha256": F.coalesce("sha256", own), "has_geotag": F.col("file") % 3 == 0})


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos_of(standard(spark, sf_dir), spark, sf_dir)


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that scoring takes, duplicates too; they come first, while the rows still lie by their id."""
    df = pipeline.with_duplicates(standard(spark, sf_dir), stage(images(spark, sf_dir), "photos"), "id", NEAR)
    return with_reports(df, spark, sf_dir)
