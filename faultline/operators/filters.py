"""Row predicates and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import fixed


def is_incident() -> Column:
    return F.col("is_anomaly") | F.col("level").isin(fixed.ERROR_LEVELS)


def is_alert() -> Column:
    return F.col("is_anomaly") | F.col("level").isin(fixed.ALERT_LEVELS)


def is_critical_peak() -> Column:
    return F.col("is_anomaly") & F.col("level").isin(fixed.ERROR_LEVELS)


def incidents_of(logs: DataFrame) -> DataFrame:
    return logs.where(is_incident())


def alerts_of(logs: DataFrame) -> DataFrame:
    return logs.where(is_alert())


def newest(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """Newest rows first; a limit makes it a distributed top-k."""
    ranked = df.orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def search_level(raw_logs: DataFrame, level: str, limit: int | None = 500) -> DataFrame:
    return newest(raw_logs.where(F.col("level") == level.upper()), limit, F.desc("id"))


def search_keyword(raw_logs: DataFrame, keyword: str, limit: int | None = 500) -> DataFrame:
    """Case-insensitive LIKE; ``%`` and ``_`` in the keyword stay wildcards."""
    return newest(raw_logs.where(F.col("message").ilike(f"%{keyword}%")), limit, F.desc("id"))


def get_by_id(raw_logs: DataFrame, log_id: int) -> DataFrame:
    return raw_logs.where(F.col("id") == log_id)


def list_logs(raw_logs: DataFrame, source: str | None = None, limit: int | None = 200) -> DataFrame:
    if source:
        raw_logs = raw_logs.where(F.col("source") == source)
    return newest(raw_logs, limit, F.desc("id"))


def count_logs(raw_logs: DataFrame, source: str | None = None) -> DataFrame:
    if source:
        raw_logs = raw_logs.where(F.col("source") == source)
    return raw_logs.agg(F.count(F.lit(1)).alias("n"))


def list_incidents(
    incidents: DataFrame, run_id: str | None = None, limit: int | None = 200
) -> DataFrame:
    if run_id:
        rows = incidents.where(F.col("run_id") == run_id)
        return newest(rows, limit, F.asc("line_id"), F.asc("log_source"))
    return newest(incidents, limit, F.desc("created_at"), F.desc("line_id"))


def search_incidents(incidents: DataFrame, text: str, limit: int | None = 500) -> DataFrame:
    pattern = f"%{text}%"
    hit = F.lit(False)
    for name in ("raw_log", "root_cause", "recommendation", "log_source"):
        hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return newest(incidents.where(hit), limit, F.desc("created_at"), F.desc("line_id"))


def explorer_search(logs: DataFrame, pattern: str) -> DataFrame:
    """Case-insensitive regular expression over the raw or the cleaned line."""
    if not pattern:
        return logs
    hit = F.coalesce(F.col("raw_log").rlike(f"(?iU){pattern}"), F.lit(False))
    if "clean_log" in logs.columns:
        hit = hit | F.coalesce(F.col("clean_log").rlike(f"(?iU){pattern}"), F.lit(False))
    return logs.where(hit)


def explorer_filter(
    logs: DataFrame,
    levels: list[str] | None = None,
    clusters: list[int] | None = None,
    only_alerts: bool = False,
    max_rows: int | None = 1000,
) -> DataFrame:
    """Facet filters, then the first rows in line order."""
    if levels:
        logs = logs.where(F.col("level").isin(levels))
    if clusters:
        logs = logs.where(F.col("semantic_cluster").isin(clusters))
    if only_alerts:
        logs = incidents_of(logs)
    return logs if max_rows is None else logs.orderBy("line_id").limit(max_rows)


def facet_values(logs: DataFrame) -> DataFrame:
    """Distinct non-null levels and clusters, one row per value."""
    parts = [
        logs.groupBy(F.col(name).cast("string").alias("value"))
        .agg(F.lit(name).alias("facet"))
        .where(F.col("value").isNotNull())
        .select("facet", "value")
        for name in ("level", "semantic_cluster")
    ]
    return parts[0].unionByName(parts[1])
