"""Ingest of a directory of log and CSV files into a raw-log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.session import cut
from faultline.sources import scan, tables


def ingest_directory(
    spark: SparkSession, path, table: str, ingest_ts: Column | str, dry_run: bool = False,
    logs: str = "*.log", csv: str = "*.csv",
) -> DataFrame:
    """(source, status, n) of every log and CSV file (by the patterns of their names); whole ones replace their source in the table.

    Failed files give no rows and leave the table's rows of their source as they are. A dry run
    only counts.
    """
    status = cut(scan.directory_status(spark, path, logs, csv))
    records = scan.scan_directory(spark, path, ingest_ts, status, logs, csv)
    if not dry_run:
        records = cut(records)
        tables.replace_sources(records, table)
    counts = records.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return status.join(cut(counts), "source", "left").select("source", "status", F.coalesce("n", F.lit(0)).alias("n"))
