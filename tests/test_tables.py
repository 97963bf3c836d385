import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.operators import filters
from faultline.sources import reports, tables


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "raw")


def records(spark, *rows):
    return spark.createDataFrame(list(rows), "line_id long, timestamp string, level string, message string, source string")


def record(n, level="INFO", source="test.log"):
    return (n, f"2026-01-0{n} 12:00:00", level, f"message number {n}", source)


def count(spark, path, source=None):
    return filters.count_logs(tables.read_raw_logs(spark, path), source).first()["n"]


def test_append_and_count(spark, path):
    assert count(spark, path) == 0
    assert tables.append_raw_logs(records(spark, record(1)), path) == 1
    assert tables.append_raw_logs(records(spark, *[record(i) for i in range(2, 6)]), path) == 4
    assert count(spark, path) == 5
    ids = [r.id for r in tables.read_raw_logs(spark, path).orderBy("line_id").collect()]
    assert len(set(ids)) == 5 and min(ids[1:]) > ids[0]


def test_append_nothing(spark, path):
    assert tables.append_raw_logs(records(spark, record(1)).limit(0), path) == 0
    assert count(spark, path) == 0


def test_defaults(spark, path):
    tables.append_raw_logs(spark.createDataFrame([("only text",)], "message string"), path)
    row = tables.read_raw_logs(spark, path).first()
    assert (row.line_id, row.timestamp, row.level, row.message, row.source, row.ts) == (
        0, "", "INFO", "only text", None, None)


def test_time_column(spark, path):
    rows = records(spark, record(1), (2, "2026-01-15T12:34:56", "INFO", "m", "s"), (3, "soon", "INFO", "m", "s"))
    tables.append_raw_logs(rows, path)
    got = {r.line_id: r.ts for r in tables.read_raw_logs(spark, path).collect()}
    assert got == {1: dt.datetime(2026, 1, 1, 12), 2: dt.datetime(2026, 1, 15, 12, 34, 56), 3: None}


def test_lookup_and_lists(spark, path):
    tables.append_raw_logs(records(
        spark, record(1, "ERROR", "a.log"), record(2, "INFO", "a.log"), record(3, "ERROR", "b.log")), path)
    logs = tables.read_raw_logs(spark, path)
    some = logs.where("line_id = 2").first()
    assert filters.get_by_id(logs, some.id).first().message == "message number 2"
    assert filters.get_by_id(logs, -5).first() is None
    assert {r.line_id for r in filters.list_logs(logs, "a.log").collect()} == {1, 2}
    assert filters.list_logs(logs, limit=2).count() == 2
    assert {r.line_id for r in filters.search_level(logs, "error").collect()} == {1, 3}
    assert count(spark, path, "a.log") == 2


def test_keyword_search(spark, path):
    rows = [(1, "", "ERROR", "Connection refused from 10.0.0.1", None),
            (2, "", "WARNING", "Disk full warning on /var/log", None),
            (3, "", "INFO", "100% done", None)]
    tables.append_raw_logs(records(spark, *rows), path)
    logs = tables.read_raw_logs(spark, path)
    assert [r.line_id for r in filters.search_keyword(logs, "CONNECTION").collect()] == [1]
    assert {r.line_id for r in filters.search_keyword(logs, "d_n").collect()} == {3}
    assert filters.search_keyword(logs, "%").count() == 3


def test_clear_source(spark, path):
    odd = "file:/x=1/a [1]*.log"
    tables.append_raw_logs(records(
        spark, record(1, source=odd), record(2, source=odd), record(3, source="other.log")), path)
    assert tables.clear_source(spark, path, odd) == 2
    assert tables.clear_source(spark, path, "absent") == 0
    assert count(spark, path, odd) == 0
    assert count(spark, path) == 1


def test_long_source_and_dense_ids(spark, path):
    long = "file:/" + "/".join("folder" * 6 for _ in range(12)) + "/a.log"
    tables.append_raw_logs(records(spark, record(1, source=long), record(2, source=long)).repartition(3), path)
    tables.replace_sources(records(spark, record(3, source=long)), path)
    rows = tables.read_raw_logs(spark, path).collect()
    assert [(r.source, r.line_id, r.id) for r in rows] == [(long, 3, 3)]


def test_emptied_buckets_remember_their_ids(spark, path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKETS", 2)
    tables.append_raw_logs(records(spark, *[record(i, source=f"s{i}") for i in range(1, 7)]), path)
    for i in range(1, 7):
        assert tables.clear_source(spark, path, f"s{i}") == 1
        assert count(spark, path) == 6 - i
    tables.replace_sources(records(spark, record(1, source="s1"), record(2, source=None)), path)
    tables.replace_sources(records(spark, record(3, source="s1"), record(4, source=None)), path)
    rows = {(r.source, r.line_id): r.id for r in tables.read_raw_logs(spark, path).collect()}
    assert set(rows) == {("s1", 3), (None, 2), (None, 4)} and min(rows.values()) > 6


def test_only_touched_buckets_are_written_again(spark, path):
    import os

    sources = [f"s{i}" for i in range(40)]
    tables.append_raw_logs(records(spark, *[record(1, source=s) for s in sources]), path)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    tables.replace_sources(records(spark, record(2, source="s7")), path)
    assert len({os.path.dirname(f) for f in before - files()}) == 1
    assert {(r.source, r.line_id) for r in tables.read_raw_logs(spark, path).collect()} == {
        (s, 2 if s == "s7" else 1) for s in sources
    }


def test_replace_source_keeps_the_others(spark, path):
    tables.append_raw_logs(records(spark, record(1, source="a"), record(2, source="b")), path)
    assert tables.replace_sources(records(spark, record(3, source="a"), record(4, source="a")), path) == 2
    got = {(r.source, r.line_id) for r in tables.read_raw_logs(spark, path).collect()}
    assert got == {("a", 3), ("a", 4), ("b", 2)}


def logs(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "line_id long, raw_log string, level string, event_template string, is_anomaly boolean, "
        "anomaly_score double, semantic_cluster int, root_cause string, recommendation string",
    )


def log(n, level="INFO", anomaly=False):
    return (n, f"raw {n}", level, f"t {n}", anomaly, 0.1, 0, "cause", "action")


def test_save_incidents(spark, tmp_path, path):
    store = str(tmp_path / "incidents")
    assert tables.save_incidents(logs(spark, log(1)), store, "a.log", "run_1") == 0
    assert tables.read_incidents(spark, store).count() == 0
    assert tables.save_incidents(logs(spark, log(1), log(2, "ERROR"), log(3, anomaly=True)), store, "a.log", "run_1") == 2
    assert tables.save_incidents(logs(spark, log(4, "FATAL")), store, "b.log", "run_2") == 1
    # A later run of the same source takes the place of the earlier one.
    tables.append_raw_logs(records(spark, record(1, source="a.log"), record(2, source="b.log")), path)
    assert tables.save_incidents(logs(spark, log(5, "CRITICAL")), store, "a.log", "run_3", raw_path=path) == 1
    stored = tables.read_incidents(spark, store)
    assert {(r.log_source, r.run_id, r.line_id) for r in stored.collect()} == {
        ("a.log", "run_3", 5), ("b.log", "run_2", 4)}
    assert count(spark, path, "a.log") == 0 and count(spark, path, "b.log") == 1
    assert stored.where("created_at is null").isEmpty()
    # No incidents: nothing is deleted.
    assert tables.save_incidents(logs(spark, log(6)), store, "a.log", "run_4") == 0
    assert tables.read_incidents(spark, store).count() == 2


def test_unknown_source_appends_and_runs_drop(spark, tmp_path):
    store = str(tmp_path / "incidents")
    tables.save_incidents(logs(spark, log(2, "ERROR"), log(1, "ERROR")), store, run_id="run_1")
    tables.save_incidents(logs(spark, log(3, "ERROR")), store, run_id="run_2")
    stored = tables.read_incidents(spark, store)
    assert stored.count() == 3
    restored = tables.restore_run(stored, "run_1").collect()
    assert [(r.line_id, r.clean_log) for r in restored] == [(1, "raw 1"), (2, "raw 2")]
    assert tables.delete_run(spark, store, "run_1") == 1
    assert {r.line_id for r in tables.read_incidents(spark, store).collect()} == {3}
    assert tables.delete_run(spark, store, "absent") == 0


def test_reports(spark, tmp_path):
    rows = logs(spark, log(1, "ERROR"), log(2, anomaly=True), log(3))
    exported = reports.alert_export(rows)
    assert exported.columns == [c for c in reports.ALERT_COLUMNS if c != "clean_log"]
    assert [r.line_id for r in exported.collect()] == [2, 1]
    for format in ("csv", "json", "xlsx"):
        out = str(tmp_path / format)
        reports.write_report(exported, out, format)
        reader = spark.read.option("header", "true")
        back = reader.json(out) if format == "json" else reader.csv(out)
        assert {int(r.line_id) for r in back.collect()} == {1, 2}
    with pytest.raises(ValueError):
        reports.write_report(exported, str(tmp_path / "x"), "pdf")


def test_json_report_of_nothing(spark):
    import json

    empty = logs(spark, log(1)).limit(0).withColumn("clean_log", F.col("raw_log"))
    report = json.loads(reports.json_report(empty, "r", "s", "now").first()["report"])
    assert report["stats"]["total_lines"] == 0
    assert report["stats"]["anomaly_rate"] == 0
    assert report["top_alerts"] == []
    assert report["executive_summary"]["domain"] == "Operacion general del servidor"


def test_new_rows_are_written_aside_twice_and_never_dealt_by_partition(spark, path, monkeypatch):
    n, written, plans = 40, [], []
    plain = tables.cut

    def counted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(tables, "cut", counted)
    for _ in range(2):
        written.clear()
        rows = spark.range(n).selectExpr("id as line_id", "'' as timestamp", "'INFO' as level", "string(id) as message", "'a' as source")
        assert tables.replace_sources(rows.repartition(3), path) == n
        assert sum(written) < 2 * n + 10
    stored = tables.read_raw_logs(spark, path).collect()
    assert sorted(int(r.message) for r in stored) == list(range(n)) and {r.id for r in stored} == set(range(n + 1, 2 * n + 1))
    by_part = [line for plan in plans for line in plan.splitlines() if "Join" in line and "_part" in line]
    assert by_part and all("broadcast" in line for line in by_part)
