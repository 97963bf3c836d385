"""Aggregates behind the overview, alert and pattern views.

All of them reduce on the map side first. Scores carry four decimals by
definition, so means are taken over whole ten-thousandths and do not depend on
the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import fixed
from faultline.functions.levels import severity_rank, timeline_height
from faultline.functions.rules import keyword_hits
from faultline.functions.text import snippet
from faultline.operators.filters import alerts_of, incidents_of, is_critical_peak


def _n() -> Column:
    return F.count(F.lit(1))


def _anomalies() -> Column:
    return F.count_if("is_anomaly")


def _of_levels(levels: list[str]) -> Column:
    return F.count_if(F.col("level").isin(levels))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def _score_units() -> Column:
    return F.bround(F.col("anomaly_score") * 10000).cast("bigint")


# --- Totals -----------------------------------------------------------------


def totals(logs: DataFrame) -> DataFrame:
    return logs.agg(
        _n().alias("total"),
        _anomalies().alias("anomalies"),
        _of_levels(fixed.ERROR_LEVELS).alias("errors"),
        _of_levels(fixed.CRITICAL_LEVELS).alias("critical"),
    )


def kpi_metrics(logs: DataFrame) -> DataFrame:
    """Totals, distinct clusters and anomaly rate, in one row."""
    # Distinct clusters come from the per-cluster partial counts, so no row is
    # expanded for the distinct aggregate.
    per_cluster = logs.groupBy("semantic_cluster").agg(
        _n().alias("n"),
        _anomalies().alias("a"),
        _of_levels(fixed.ERROR_LEVELS).alias("e"),
        _of_levels(fixed.CRITICAL_LEVELS).alias("c"),
    )
    row = per_cluster.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("anomalies"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("errors"),
        F.count("semantic_cluster").alias("clusters"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("critical"),
    )
    return row.withColumn("anomaly_rate", _rate(F.col("anomalies"), F.col("total")))


def risk_index(logs: DataFrame) -> DataFrame:
    raw = (
        F.col("critical") * 18
        + F.col("errors") * 9
        + F.col("anomalies") * 12
        + _rate(F.col("anomalies"), F.col("total"))
    )
    score = totals(logs).select(
        F.least(F.lit(100), F.bround(raw).cast("bigint")).cast("bigint").alias("risk_score")
    )
    label = (
        F.when(F.col("risk_score") >= 70, "Alto")
        .when(F.col("risk_score") >= 35, "Medio")
        .otherwise("Bajo")
    )
    return score.withColumn("risk_label", label)


def system_status(logs: DataFrame) -> DataFrame:
    has_critical = F.col("critical") > 0
    return totals(logs).select(
        F.when(has_critical, "Crítico")
        .when(F.col("anomalies") > 0, "Atención")
        .otherwise("Estable")
        .alias("status"),
        F.when(has_critical | (F.col("anomalies") > 2), "Alta")
        .when(F.col("anomalies") > 0, "Media")
        .otherwise("Baja")
        .alias("priority"),
    )


def alert_badge(logs: DataFrame) -> DataFrame:
    """Badge of the alert inbox and of the header (the latter counts anomalies)."""

    def badge(n: Column, words: tuple[str, str, str]) -> Column:
        return F.when(n > 5, words[0]).when(n > 0, words[1]).otherwise(words[2])

    row = logs.agg(
        F.count_if(F.col("is_anomaly") | F.col("level").isin(fixed.ERROR_LEVELS)).alias("alerts"),
        _anomalies().alias("anomalies"),
        _of_levels(fixed.ERROR_LEVELS).alias("errors"),
    )
    return row.select(
        "alerts",
        badge(F.col("alerts"), ("CRÍTICO", "ATENCIÓN", "ESTABLE")).alias("badge"),
        "anomalies",
        "errors",
        badge(F.col("anomalies"), ("Crítico", "Atención", "Estable")).alias("header_badge"),
    )


def incident_summary(incidents: DataFrame, run_id: str | None = None) -> DataFrame:
    """Totals and a level -> count map; zeros and an empty map when there is nothing."""
    if run_id:
        incidents = incidents.where(F.col("run_id") == run_id)
    per_level = incidents.groupBy("level").agg(_n().alias("n"), _anomalies().alias("a"))
    pairs = F.collect_list(
        F.when(F.col("level").isNotNull(), F.struct(F.col("level").alias("key"), F.col("n").alias("value")))
    )
    return per_level.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("anomalies"),
        F.coalesce(
            F.sum(F.when(F.col("level").isin(fixed.ERROR_LEVELS), F.col("n"))), F.lit(0)
        ).alias("errors"),
        F.map_from_entries(F.array_sort(pairs)).alias("severity_counts"),
    )


def score_range(logs: DataFrame) -> DataFrame:
    row = logs.agg(
        F.coalesce(F.min("anomaly_score"), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max("anomaly_score"), F.lit(1.0)).alias("top"),
    )
    flat = F.col("min_score") >= F.col("top")
    return row.select(
        "min_score",
        F.when(flat, F.col("min_score") + 1.0).otherwise(F.col("top")).alias("max_score"),
    )


# --- Distributions ----------------------------------------------------------


def severity_distribution(logs: DataFrame) -> DataFrame:
    """Rows and share (one decimal) per level, in natural severity order."""
    counts = logs.groupBy("level").agg(_n().alias("n"))
    # One row per level: the total is a window over that handful of rows.
    total = F.sum("n").over(W.partitionBy())
    return (
        counts.withColumn("percentage", F.bround(F.col("n") / total * 100, 1))
        .withColumn("severity_rank", severity_rank(F.col("level")))
        .orderBy("severity_rank", "level")
    )


def cluster_label(cluster: Column) -> Column:
    return F.when(cluster >= 0, F.concat(F.lit("Cluster "), cluster.cast("string"))).otherwise(
        fixed.UNASSIGNED
    )


def cluster_counts(logs: DataFrame) -> DataFrame:
    return (
        logs.where(F.col("semantic_cluster").isNotNull())
        .groupBy("semantic_cluster")
        .agg(_n().alias("n"))
        .withColumn("cluster_label", cluster_label(F.col("semantic_cluster")))
        .orderBy("semantic_cluster")
    )


def cluster_heatmap(logs: DataFrame, top: int | None = 12) -> DataFrame:
    """Level counts of the largest clusters (all without ``top``), one column per level; one pass."""
    level = {name: F.count_if(F.col("level") == name).alias(name) for name in fixed.SEVERITY_ORDER}
    cells = (
        logs.where(F.col("semantic_cluster").isNotNull())
        .groupBy("semantic_cluster")
        .agg(_n().alias("_size"), *level.values())
        .orderBy(F.desc("_size"), "semantic_cluster")
    )
    return (
        (cells if top is None else cells.limit(top))
        .drop("_size")
        .withColumn("cluster_label", cluster_label(F.col("semantic_cluster")))
        .orderBy("semantic_cluster")
    )


def alert_severity(logs: DataFrame) -> DataFrame:
    return incidents_of(logs).groupBy("level").agg(_n().alias("n")).orderBy(F.desc("n"), "level")


def top_templates(logs: DataFrame, limit: int | None = 5) -> DataFrame:
    ranked = (
        logs.where(F.col("event_template").isNotNull())
        .groupBy("event_template")
        .agg(_n().alias("n"))
        .orderBy(F.desc("n"), "event_template")
    )
    return ranked if limit is None else ranked.limit(limit)


def root_cause_summary(logs: DataFrame, limit: int | None = None) -> DataFrame:
    ranked = (
        logs.groupBy("root_cause")
        .agg(_n().alias("n"), _anomalies().alias("anomalies"), F.max("anomaly_score").alias("score_max"))
        .orderBy(F.desc("n"), "root_cause")
    )
    return ranked if limit is None else ranked.limit(limit)


def pattern_stats(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Per template: size, anomalies, best and mean score, dominant level, rate.

    Rows are first reduced to (template, level), so that the dominant level is a
    ``max_by`` over at most a handful of rows per template, however hot it is.
    """
    by_level = logs.groupBy("event_template", "level").agg(
        _n().alias("n"),
        _anomalies().alias("a"),
        F.max("anomaly_score").alias("top"),
        F.sum(_score_units()).alias("units"),
        F.count("anomaly_score").alias("scored"),
        F.min("line_id").alias("first_line"),
    )
    best_level = F.when(
        F.col("level").isNotNull(), F.struct(F.col("n"), -F.col("first_line"))
    )
    stats = by_level.groupBy("event_template").agg(
        F.sum("n").alias("n"),
        F.sum("a").alias("anomalies"),
        F.bround(F.max("top"), 4).alias("score_max"),
        (F.bround(F.sum("units") / F.sum("scored")) / 10000).alias("score_mean"),
        F.max_by("level", best_level).alias("dominant_level"),
    )
    ranked = stats.withColumn(
        "anomaly_rate", F.bround(F.col("anomalies") / F.col("n") * 100, 1)
    ).orderBy(F.desc("anomalies"), "event_template")
    return ranked if limit is None else ranked.limit(limit)


# --- Domain and executive summary ---------------------------------------------


def _text_of(logs: DataFrame) -> Column:
    if "clean_log" in logs.columns:
        return F.coalesce(F.col("clean_log"), F.col("raw_log"))
    return F.col("raw_log")


def log_domain(logs: DataFrame, first_rows: int | None = None) -> DataFrame:
    """Keyword occurrences per domain over all rows, zero scores left out.

    ``first_rows`` restricts the count to the first rows in line order.
    """
    rows = logs.select("line_id", _text_of(logs).alias("text"))
    if first_rows is not None:
        rows = rows.orderBy("line_id").limit(first_rows)
    sums = rows.agg(
        *[
            F.coalesce(F.sum(keyword_hits(F.col("text"), words)), F.lit(0)).alias(f"d{i}")
            for i, (_, words) in enumerate(fixed.DOMAINS)
        ]
    )
    unpivoted = sums.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("priority"),
                        F.lit(name).alias("domain"),
                        F.col(f"d{i}").alias("score"),
                    )
                    for i, (name, _) in enumerate(fixed.DOMAINS)
                ]
            )
        ).alias("d")
    ).select("d.*")
    return (
        unpivoted.where(F.col("score") > 0)
        .orderBy(F.desc("score"), "priority")
        .select("domain", "score", "priority")
    )


def executive_summary(logs: DataFrame) -> DataFrame:
    """One row: main domain, posture, focus and the totals behind them."""
    hits = [
        F.coalesce(F.sum(keyword_hits(_text_of(logs), words)), F.lit(0)).alias(f"d{i}")
        for i, (_, words) in enumerate(fixed.DOMAINS)
    ]
    row = logs.agg(
        _n().alias("total"),
        _anomalies().alias("anomalies"),
        _of_levels(fixed.ERROR_LEVELS).alias("errors"),
        _of_levels(fixed.CRITICAL_LEVELS).alias("critical"),
        *hits,
    )
    best = F.greatest(*[F.col(f"d{i}") for i in range(len(fixed.DOMAINS))])
    domain = F.lit(fixed.NO_DOMAIN)
    for i in reversed(range(len(fixed.DOMAINS))):
        domain = F.when((best > 0) & (F.col(f"d{i}") == best), fixed.DOMAINS[i][0]).otherwise(domain)
    return row.select(
        domain.alias("domain"),
        F.when(F.col("critical") > 0, fixed.POSTURE_CRITICAL)
        .when((F.col("anomalies") > 0) | (F.col("errors") > 0), fixed.POSTURE_DEGRADED)
        .otherwise(fixed.POSTURE_CALM)
        .alias("posture"),
        F.when(F.col("anomalies") > 0, fixed.FOCUS_ANOMALIES)
        .when(F.col("errors") > 0, fixed.FOCUS_ERRORS)
        .otherwise(fixed.FOCUS_CALM)
        .alias("focus"),
        F.concat(
            F.format_number("total", 0), F.lit(" eventos procesados, "),
            F.format_number("errors", 0), F.lit(" errores y "),
            F.format_number("anomalies", 0), F.lit(" anomalias."),
        ).alias("volume"),
        "total",
        "errors",
        "anomalies",
        "critical",
    )


# --- Ordered views ------------------------------------------------------------


def alert_inbox(logs: DataFrame) -> DataFrame:
    return (
        incidents_of(logs)
        .orderBy(F.desc("is_anomaly"), F.desc("anomaly_score"), "line_id")
        .select(
            "line_id", "level", "is_anomaly", "anomaly_score",
            "event_template", "root_cause", "recommendation",
        )
    )


def alert_timeline(logs: DataFrame, limit: int | None = 300) -> DataFrame:
    """Alerts in line order; beyond a limit the highest scores are kept."""
    alerts = alerts_of(logs)
    if limit is not None:
        alerts = alerts.orderBy(F.desc("anomaly_score"), "line_id").limit(limit)
    return (
        alerts.select(
            "line_id",
            "level",
            "is_anomaly",
            F.bround("anomaly_score", 4).alias("anomaly_score"),
            timeline_height(F.col("level")).alias("y_pos"),
            "root_cause",
            "recommendation",
            snippet(F.col("clean_log"), 100).alias("snippet"),
        )
        .orderBy("line_id")
    )


def risk_peaks(logs: DataFrame, trend: DataFrame, keys: list[str], limit: int | None = 60) -> DataFrame:
    """Highest-scoring critical anomalies with their smoothed risk."""
    peaks = logs.where(is_critical_peak())
    if limit is not None:
        peaks = peaks.orderBy(F.desc("anomaly_score"), "line_id").limit(limit)
    peaks = peaks.select(
        *keys,
        "line_id",
        "level",
        F.bround("anomaly_score", 4).alias("anomaly_score"),
        snippet(F.col("clean_log"), 70).alias("snippet"),
    )
    # A limited side is safe to broadcast; of all peaks nothing is known.
    risk = trend.select(*keys, "line_id", "normalized_risk")
    return risk.join(peaks if limit is None else F.broadcast(peaks), [*keys, "line_id"])
