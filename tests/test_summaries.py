import pytest
from pyspark.sql import functions as F

from faultline.operators import history, summaries, trend

COLUMNS = (
    "line_id long, raw_log string, clean_log string, level string, event_template string, "
    "is_anomaly boolean, anomaly_score double, semantic_cluster int, root_cause string, "
    "recommendation string, log_source string, run_id string"
)


def frame(spark, rows):
    full = []
    for i, r in enumerate(rows, 1):
        full.append((
            i, r.get("raw", f"line {i}"), r.get("raw", f"line {i}"), r.get("level", "INFO"), r.get("template", "t"),
            r.get("anomaly", False), r.get("score"), r.get("cluster"), r.get("cause", "c"), "a",
            r.get("source", "s"), r.get("run", "r"),
        ))
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture
def nothing(spark):
    return frame(spark, [{}]).limit(0)


def test_zero_rows(nothing):
    k = summaries.kpi_metrics(nothing).first()
    assert tuple(k) == (0, 0, 0, 0, 0, 0.0)
    assert tuple(summaries.risk_index(nothing).first()) == (0, "Bajo")
    assert tuple(summaries.system_status(nothing).first()) == ("Estable", "Baja")
    assert summaries.alert_badge(nothing).first().badge == "ESTABLE"
    s = summaries.incident_summary(nothing).first()
    assert (s.total, s.anomalies, s.errors, s.severity_counts) == (0, 0, 0, {})
    assert tuple(summaries.score_range(nothing).first()) == (0.0, 1.0)
    assert summaries.severity_distribution(nothing).count() == 0
    assert summaries.log_domain(nothing).count() == 0
    assert history.history_totals(nothing.withColumn("created_at", F.current_timestamp())).first().n_runs == 0


def test_score_range_of_equal_scores(spark):
    row = summaries.score_range(frame(spark, [{"score": 0.5}, {"score": 0.5}])).first()
    assert tuple(row) == (0.5, 1.5)


@pytest.mark.parametrize("rows, want", [
    ([{"level": "ERROR"}, {}, {}, {}], (9, "Bajo")),
    ([{"anomaly": True}, {"anomaly": True}, {}, {}], (74, "Alto")),
    ([{"level": "CRITICAL"}, {"level": "ERROR"}], (36, "Medio")),
    # 12 + 12.5 rounds half to even.
    ([{"anomaly": True}] + [{}] * 7, (24, "Bajo")),
])
def test_risk_index(spark, rows, want):
    assert tuple(summaries.risk_index(frame(spark, rows)).first()) == want


def test_status_and_priority(spark):
    assert tuple(summaries.system_status(frame(spark, [{"anomaly": True}])).first()) == ("Atención", "Media")
    assert tuple(summaries.system_status(frame(spark, [{"anomaly": True}] * 3)).first()) == ("Atención", "Alta")
    assert tuple(summaries.system_status(frame(spark, [{"level": "FATAL"}])).first()) == ("Crítico", "Alta")


def test_pattern_stats_ties(spark):
    rows = [{"template": "a", "level": "ERROR", "score": 0.1}, {"template": "a", "level": "INFO", "score": 0.2001},
            {"template": "b", "level": "INFO", "anomaly": True}]
    got = {r.event_template: r for r in summaries.pattern_stats(frame(spark, rows)).collect()}
    assert got["a"].dominant_level == "ERROR"  # first seen of the tied levels
    assert got["a"].score_mean == 0.15 and got["a"].score_max == 0.2001
    assert got["b"].anomaly_rate == 100.0 and got["b"].score_mean is None
    assert summaries.pattern_stats(frame(spark, rows), 1).first().event_template == "b"


def test_domain_counts_occurrences(spark):
    rows = [{"raw": "Database db timeout timeout"}, {"raw": "disk"}]
    got = {r.domain: r.score for r in summaries.log_domain(frame(spark, rows)).collect()}
    assert got == {"Base de datos": 2, "Red / conectividad": 2, "Disco / almacenamiento": 1}
    first = {r.domain for r in summaries.log_domain(frame(spark, rows), first_rows=1).collect()}
    assert "Disco / almacenamiento" not in first
    row = summaries.executive_summary(frame(spark, rows)).first()
    assert row.domain == "Base de datos" and row.volume == "2 eventos procesados, 0 errores y 0 anomalias."


def test_cluster_views(spark):
    rows = [{"cluster": c, "level": l} for c, l in [(0, "INFO"), (0, "ERROR"), (-1, "INFO"), (2, "INFO"), (2, "INFO"), (None, "INFO")]]
    counts = [(r.cluster_label, r.n) for r in summaries.cluster_counts(frame(spark, rows)).collect()]
    assert counts == [("Sin asignar", 1), ("Cluster 0", 2), ("Cluster 2", 2)]
    heat = summaries.cluster_heatmap(frame(spark, rows), 2).collect()
    assert [(r.semantic_cluster, r.INFO, r.ERROR, r.FATAL) for r in heat] == [(0, 1, 1, 0), (2, 2, 0, 0)]


@pytest.mark.parametrize("n, bucket", [(7, 3), (260, 16), (437, 64), (1, 5)])
def test_risk_trend_against_pandas(spark, n, bucket):
    import pandas as pd

    data = {s: [((i * 7919 + k) % 1000 - 300) / 10000 for i in range(n)] for k, s in enumerate("ab")}
    rows = [(s, i * 3 + 1, v) for s, values in data.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "log_source string, line_id long, anomaly_score double").repartition(5)
    got = trend.risk_trend(df, ["log_source"], bucket).orderBy("log_source", "line_id").toPandas()
    for s, values in data.items():
        smooth = pd.Series(values).rolling(max(5, n // 40), min_periods=1, center=True).mean()
        scaled = (smooth - smooth.min()) / max(smooth.max() - smooth.min(), 1e-6)
        mine = got[got.log_source == s].reset_index(drop=True)
        assert (mine.smoothed_risk - smooth).abs().max() < 1e-9
        assert (mine.normalized_risk - scaled).abs().max() < 1e-6
        assert (mine.low_band - scaled.clip(upper=0.4)).abs().max() < 1e-6
        assert (mine.high_band - scaled.clip(lower=0.7)).abs().max() < 1e-6


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_positions_by_groups_of_buckets(spark, group):
    values = {s: [(i * 31 + k) % 17 - 5 for i in range(90)] for k, s in enumerate("ab")}
    rows = [(s, i * 5, v) for s, listed in values.items() for i, v in enumerate(listed)]
    df = spark.createDataFrame(rows, "log_source string, line_id long, v long").repartition(4)
    found = trend.with_position(df, ["log_source"], "v", 8, group).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.pos, r.n_rows) == (r.line_id // 5 + 1, 90)
        assert r.running == sum(values[r.log_source][: r.pos])
    assert trend.with_position(df.where("false"), ["log_source"], "v", 8, group).count() == 0


def test_compare_with_a_missing_run(spark):
    rows = frame(spark, [{"run": "r1", "level": "ERROR"}, {"run": "r1"}])
    row = history.compare_runs(rows, ("r0", "s"), ("r1", "s")).first()
    assert (row.total_events_a, row.total_events_b, row.total_events_diff, row.total_events_pct) == (0, 2, 2, 0.0)
    back = history.compare_runs(rows, ("r1", "s"), ("r0", "s")).first()
    assert (back.errors_diff, back.errors_pct) == (-1, -100.0)
