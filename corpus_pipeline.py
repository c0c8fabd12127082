"""The corpus pipeline: language, quality, near-duplicates, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm import stages

STAGES = stages.STAGES

#: Language ID, quality scores and packing go beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return stages.run(spark, docs, sf_dir)
