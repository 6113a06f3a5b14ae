"""Corpus pipeline: each stage reads what its predecessor kept, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rubrica.llm.common import stage, table
from rubrica.llm.decontaminate import keep_clean
from rubrica.llm.langid import keep_identified
from rubrica.llm.mixing import mixed
from rubrica.llm.neardup import keep_one
from rubrica.llm.sharding import assign


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeat as the mixture asks; each document stays at least once."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and slot on the Hilbert curve, beside its own columns."""
    return assign(docs, carry=[c for c in docs.columns if c != "doc_id"])


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The stages learn models and verify similarities, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
