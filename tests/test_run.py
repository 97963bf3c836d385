import random

import pytest

from faultline.operators.history import list_runs
from faultline.operators import templates
from faultline.plans.run import parse, run, run_on
from faultline.sources.tables import read_incidents

LINES = [
    ("INFO", "Incoming request GET /api/{} from 192.168.1.{}"),
    ("INFO", "Request processed successfully in {}ms node {}"),
    ("ERROR", "Database connection timeout after {} on pool {}"),
    ("WARNING", "Failed login attempt for user {} from IP 10.0.0.{}"),
    ("CRITICAL", "Worker process PID {} killed by OOM killer {}"),
]


@pytest.fixture
def log(tmp_path):
    rnd = random.Random(1)
    out = []
    for i in range(120):
        level, text = LINES[0 if i % 3 else rnd.randrange(5)]
        out.append(f"2026-05-25 08:{i // 60:02}:{i % 60:02} {level} " + text.format(rnd.randrange(9), rnd.randrange(99)))
        if i % 10 == 0:
            out.append("")
    path = tmp_path / "app.log"
    path.write_text("\n".join(out))
    return str(path)


def test_run_without_storing(spark, log):
    result = run(spark, log)
    assert result.run_id.startswith("run_") and result.log_source == "app.log"
    assert result.saved_incidents == 0
    assert result.profile.first().non_empty_lines == 120
    rows = result.logs.collect()
    assert len(rows) == len({r.line_id for r in rows}) == 120
    assert {"event_id", "event_template", "is_anomaly", "anomaly_score", "dbscan_cluster", "semantic_cluster",
            "root_cause", "recommendation", "severity_label"} <= set(result.logs.columns)
    assert sum(r.is_anomaly for r in rows) == pytest.approx(18, abs=8)
    assert result.statistical_backend == "dbscan" and result.semantic_backend == "tfidf"
    for r in rows:
        if r.level in ("WARNING", "ERROR", "CRITICAL") or r.is_anomaly:
            assert r.root_cause != "Comportamiento normal"
        else:
            assert r.root_cause == "Comportamiento normal"


def test_run_stores_incidents_once(spark, log, tmp_path):
    store = str(tmp_path / "incidents")
    first = run(spark, log, incidents_path=store, method="kmeans", n_clusters=3)
    second = run(spark, log, incidents_path=store, method="kmeans", n_clusters=3)
    assert first.persistence_error is None and second.persistence_error is None
    assert first.saved_incidents == second.saved_incidents > 0
    runs = list_runs(read_incidents(spark, store)).collect()
    assert [(r.run_id, r.total_events) for r in runs] == [(second.run_id, second.saved_incidents)]
    assert second.statistical_backend == "kmeans"


def test_run_stores_its_lines_once(spark, log, tmp_path):
    from faultline.sources.tables import read_raw_logs

    raw = str(tmp_path / "raw")
    for _ in range(2):
        run(spark, log, incidents_path=str(tmp_path / "i"), raw_path=raw)
    rows = read_raw_logs(spark, raw).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in rows} == {"app.log": 120, "profile": 2}


def test_embedder_and_its_failure(spark, log):
    good = run(spark, log, encode=lambda texts: [[float(len(t) % 3 == k) for k in range(3)] for t in texts])
    assert good.semantic_backend == "embedder"
    assert {r.semantic_cluster for r in good.logs.collect()} <= {0, 1, 2}

    def broken(texts):
        raise RuntimeError("no model")

    assert run(spark, log, encode=broken).semantic_backend == "tfidf (embedder failed)"


def test_empty_log(spark, tmp_path):
    (tmp_path / "empty.log").write_text("\n \n")
    with pytest.raises(ValueError):
        run(spark, str(tmp_path / "empty.log"))
    with pytest.raises(Exception):
        run(spark, str(tmp_path / "absent.log"))


def test_one_line(spark):
    lines = spark.createDataFrame([("s", 1, "ERROR disk")], "log_source string, line_id long, raw_log string")
    row = run_on(lines, "s").logs.first()
    assert (row.dbscan_cluster, row.semantic_cluster, row.event_id) == (0, 0, 1)


def test_lines_of_one_split_are_parsed_by_several_tasks(spark, monkeypatch):
    tasks = spark.sparkContext.accumulator(0)

    def counted(batches):
        tasks.add(1)
        yield from batches

    def seen(logs, text, max_chars=None, prepare=templates._prepare):
        return prepare(logs.mapInArrow(counted, logs.schema), text, max_chars)

    monkeypatch.setattr(templates, "_prepare", seen)
    lines = spark.range(0, 400, 1, 1).selectExpr("'s' log_source", "id line_id", "concat('line of ', id % 7, 'x') raw_log")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert parse(lines).count() == 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks.value > 1
