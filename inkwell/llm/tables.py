"""Reads the given tables for the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_key, file_type, file_name, page, title, content) of chunks and loader_results, repeated rows included."""
    meta = [F.col(f"metadata.{name}").alias(name) for name in ("file_type", "file_name", "page", "title")]
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("id").alias("rec_key"), *meta, "content")
    results = table(spark, sf_dir, "loader_results").select(F.lit("loader_results").alias("tbl"), F.col("result_id").cast("string").alias("rec_key"), *meta, "content")
    return chunks.unionByName(results)
