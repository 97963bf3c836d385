"""Log views derived from the ``events`` table.

``scored`` has the columns a finished run would have; its scores and clusters are
arithmetic stand-ins, so that every operator can be compared with plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions.levels import parse_header
from faultline.functions.text import clean, masked_line
from faultline.operators.diagnosis import attach_diagnosis, diagnose_by_rules, alert_texts
from faultline.operators.filters import incidents_of

INGEST_TS = "1970-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    user, event = F.col("user_id"), F.col("event_id")
    v = F.floor("value").cast("bigint")
    tenths = F.floor(F.col("value") * 10).cast("bigint")
    kind = F.col("event_type")
    level = (
        F.when((kind == "error") & (F.col("value") >= 100), "CRITICAL")
        .when(kind == "error", "ERROR")
        .when(kind == "signup", "WARNING")
        .when(kind == "click", "DEBUG")
        .otherwise("INFO")
    )
    error = (
        F.when(user % 4 == 0, _text("Database connection timeout after ", v, "ms on pool connection ", user))
        .when(
            user % 4 == 1,
            _text("Network unreachable: connection refused by 10.0.", user % 256, ".", v % 256,
                  " on port ", user + 5000),
        )
        .when(user % 4 == 2, _text("Disk write failed on volume /data/", user % 7))
        .otherwise(_text("Worker process PID ", event, " killed by OOM killer"))
    )
    message = (
        F.when(kind == "error", error)
        .when(kind == "signup",
              _text("Failed login attempt for user ", user, " from IP 192.168.1.", user % 256))
        .when(kind == "click", _text("Thread pool stats: ", v, " active, ", user % 9, " idle"))
        .when(kind == "view",
              _text("Incoming request GET /api/items/", user, " from 192.168.0.", v % 256))
        .otherwise(_text("Payment processed for order ORD-", event, " in ", v, "ms"))
    )
    return events.select(
        (event + 1).alias("line_id"),
        _text("src", user % 4, ".log").alias("log_source"),
        _text("run_", F.dayofmonth("ts") % 3).alias("run_id"),
        F.col("ts").alias("created_at"),
        level.alias("level"),
        F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, message).alias("raw_log"),
        (tenths > 1000).alias("is_anomaly"),
        ((tenths.cast("double") - 1000) / 10000).alias("anomaly_score"),
        (user % 5 - 1).cast("int").alias("semantic_cluster"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("line_id", "log_source", "raw_log")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` with the cleaned line and the masked line as its template."""
    return (
        scored(spark, sf_dir)
        .withColumn("clean_log", clean(F.col("raw_log")))
        .withColumn("event_template", masked_line(F.col("raw_log")))
    )


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir)
    return attach_diagnosis(rows, diagnose_by_rules(alert_texts(rows)))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_of(diagnosed(spark, sf_dir))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir)
    parts = parse_header(F.col("raw_log"), F.lit(INGEST_TS))
    return rows.select(
        F.col("line_id").alias("id"),
        "line_id",
        *[value.alias(name) for name, value in parts.items()],
        F.col("log_source").alias("source"),
    )
