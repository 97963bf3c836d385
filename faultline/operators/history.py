"""Runs, their comparison and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import fixed


def list_runs(incidents: DataFrame) -> DataFrame:
    return (
        incidents.groupBy("run_id", "log_source")
        .agg(
            F.min("created_at").alias("created_at"),
            F.count(F.lit(1)).alias("total_events"),
            F.count_if("is_anomaly").alias("anomalies"),
            F.count_if(F.col("level").isin(fixed.ERROR_LEVELS)).alias("errors"),
        )
        .orderBy(F.desc("created_at"), "run_id", "log_source")
    )


def history_totals(incidents: DataFrame) -> DataFrame:
    runs = list_runs(incidents)
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
    )


def recent_runs(incidents: DataFrame, limit: int = 8) -> DataFrame:
    return list_runs(incidents).limit(limit)


def _delta(name: str) -> list[Column]:
    a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
    diff = b - a
    percent = F.when(a == 0, F.lit(0.0)).otherwise(diff * 100.0 / F.when(a != 0, a))
    return [
        a.alias(f"{name}_a"),
        b.alias(f"{name}_b"),
        diff.alias(f"{name}_diff"),
        F.bround(percent, 1).alias(f"{name}_pct"),
    ]


def compare_runs(incidents: DataFrame, run_a: tuple[str, str], run_b: tuple[str, str]) -> DataFrame:
    """Counts of two (run_id, log_source) runs side by side, with change and percent."""

    def one(run: tuple[str, str], name: str) -> DataFrame:
        # The filter on both partition columns reads one partition only; the
        # global aggregate gives exactly one row.
        rows = incidents.where((F.col("run_id") == run[0]) & (F.col("log_source") == run[1]))
        return rows.agg(
            F.lit(1).alias("one"),
            F.count(F.lit(1)).alias("total_events"),
            F.count_if("is_anomaly").alias("anomalies"),
            F.count_if(F.col("level").isin(fixed.ERROR_LEVELS)).alias("errors"),
        ).alias(name)

    pair = one(run_a, "a").join(one(run_b, "b"), F.col("a.one") == F.col("b.one"))
    return pair.select(*_delta("total_events"), *_delta("anomalies"), *_delta("errors"))


def _templates(incidents: DataFrame, run_id: str) -> DataFrame:
    rows = incidents.where((F.col("run_id") == run_id) & F.col("event_template").isNotNull())
    return rows.select("event_template")


def new_templates(incidents: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Templates of run B that run A does not have."""
    return _templates(incidents, run_b).subtract(_templates(incidents, run_a))


def resolved_templates(incidents: DataFrame, run_a: str, run_b: str) -> DataFrame:
    return _templates(incidents, run_a).subtract(_templates(incidents, run_b))
