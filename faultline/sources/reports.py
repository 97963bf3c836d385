"""Report exports: incident dumps, alert lists and the statistics behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import fixed
from faultline.operators.filters import incidents_of
from faultline.operators.summaries import executive_summary

ALERT_COLUMNS = [
    "line_id", "level", "is_anomaly", "anomaly_score", "event_template", "root_cause",
    "recommendation", "clean_log",
]


def report_rows(incidents: DataFrame, run_id: str | None = None) -> DataFrame:
    """Incidents of a run by line, or all of them newest first."""
    if run_id:
        return incidents.where(F.col("run_id") == run_id).orderBy("line_id", "log_source")
    return incidents.orderBy(F.desc("created_at"), F.desc("line_id"))


def write_report(rows: DataFrame, path: str, format: str = "csv") -> None:
    """Write the rows as CSV or JSON lines, one file per task.

    A spreadsheet is a single-machine format; it is written as CSV.
    """
    if format in ("csv", "xlsx"):
        rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    elif format == "json":
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unsupported report format: {format}")


def alert_export(logs: DataFrame) -> DataFrame:
    """Alerts by priority, with those of the eight report columns that exist."""
    columns = [name for name in ALERT_COLUMNS if name in logs.columns]
    return (
        incidents_of(logs)
        .orderBy(F.desc("is_anomaly"), F.desc("anomaly_score"), "line_id")
        .select(*columns)
    )


def report_alerts(logs: DataFrame, limit: int | None = 150) -> DataFrame:
    """The first alerts of the report, as a distributed top-k; all without a limit."""
    ranked = alert_export(logs)
    return ranked if limit is None else ranked.limit(limit)


def report_stats(
    logs: DataFrame, silhouette: float = 0.0, davies_bouldin: float = 0.0
) -> DataFrame:
    """One row of report statistics; level counts as a JSON object in severity order."""
    per_level = logs.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("a")
    )

    def of_level(name: str) -> Column:
        return F.sum(F.when(F.col("level") == name, F.col("n"))).alias(name)

    row = per_level.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("anomaly_count"),
        F.coalesce(
            F.sum(F.when(F.col("level").isin(fixed.ERROR_LEVELS), F.col("n"))), F.lit(0)
        ).alias("error_count"),
        *[of_level(name) for name in fixed.SEVERITY_ORDER],
    )
    return row.select(
        "total_lines",
        "anomaly_count",
        F.when(F.col("total_lines") > 0, F.col("anomaly_count") / F.col("total_lines"))
        .otherwise(F.lit(0.0))
        .alias("anomaly_rate"),
        "error_count",
        F.to_json(F.struct(*fixed.SEVERITY_ORDER)).alias("severity_counts"),
        F.lit(float(silhouette)).alias("silhouette_score"),
        F.lit(float(davies_bouldin)).alias("davies_bouldin_index"),
    )


def json_report(
    logs: DataFrame,
    run_id: str,
    log_source: str,
    generated_at: str,
    silhouette: float = 0.0,
    davies_bouldin: float = 0.0,
    limit: int | None = 500,
) -> DataFrame:
    """The whole report as one JSON document (one row, column ``report``)."""
    key = F.lit(1).alias("one")
    stats = report_stats(logs, silhouette, davies_bouldin).withColumn(
        "severity_counts", F.from_json("severity_counts", "map<string,bigint>")
    )
    summary = executive_summary(logs).select("domain", "posture", "focus", "volume")
    # At most `limit` rows, gathered in their order.
    top = report_alerts(logs, limit).drop("clean_log")
    order = F.struct((~F.col("is_anomaly")).alias("p"), (-F.col("anomaly_score")).alias("s"), F.struct("*").alias("alert"))
    alerts = top.agg(F.array_sort(F.collect_list(order)).alias("a")).select(
        key, F.col("a.alert").alias("top_alerts")
    )
    return (
        stats.select(key, F.struct("*").alias("stats"))
        .join(summary.select(key, F.struct("*").alias("executive_summary")), "one")
        .join(alerts, "one")
        .select(
            F.to_json(
                F.struct(
                    F.struct(
                        F.lit(run_id).alias("run_id"),
                        F.lit(log_source).alias("log_source"),
                        F.lit(generated_at).alias("timestamp"),
                        F.lit("1.0.0").alias("analyzer_version"),
                    ).alias("metadata"),
                    "stats",
                    "executive_summary",
                    "top_alerts",
                )
            ).alias("report")
        )
    )
