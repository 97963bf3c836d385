"""Quality labels, one per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality. Ids without a label, and ids whose labels disagree, are left out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality in (0, 1) and doc_id is not null")
    once = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    return once.where("quality = _most").select("doc_id", "quality")


def held_out() -> Column:
    """True for the quarter of ids that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
