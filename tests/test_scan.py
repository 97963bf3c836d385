import csv
import random

import pytest

from faultline.sources import scan


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read(df):
    return sorted((r.file_name, r.line_id, r.raw_log) for r in df.collect())


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    want = []
    for f in range(3):
        lines = ["" if i % 5 == 3 else f"file {f} line {i} " + "x" * (i % 17) for i in range(1, 200)]
        (tmp_path / f"f{f}.log").write_text("\n".join(lines) + "\n")
        want += [(f"f{f}.log", i, t.strip()) for i, t in enumerate(lines, 1) if t]
    df = scan.scan_lines(spark, str(tmp_path), "*.log")
    assert df.rdd.getNumPartitions() > 3
    assert read(df) == sorted(want)


def test_directory_as_one_log(spark, tmp_path, small_splits):
    for f in range(3):
        (tmp_path / f"part-{f}").write_text("".join(f"{f} {i}\n" for i in range(40)))
    rows = scan.scan_lines(spark, str(tmp_path), as_one_log=True).orderBy("line_id").collect()
    assert [r.line_id for r in rows] == list(range(1, 121))
    assert [r.raw_log for r in rows] == [f"{f} {i}" for f in range(3) for i in range(40)]


def test_line_ends_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rthree\n\n \t\n\xc3\xa9t\xff\xfee\n\xa0\xc2\xa0\nend")
    rows = read(scan.scan_lines(spark, str(tmp_path)))
    assert rows == [("a.log", 1, "one"), ("a.log", 2, "two"), ("a.log", 3, "three"),
                    ("a.log", 6, "éte"), ("a.log", 8, "end")]


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def expected_csv(path):
    out = []
    with open(path, newline="", encoding="utf-8") as f:
        # Blank lines above the header are no header.
        for i, row in enumerate(csv.DictReader(f.read().lstrip("\n").splitlines(keepends=True)), 1):
            message = (row.get("message") or row.get("raw_log") or "").strip()
            if message:
                out.append((path.name, i, row.get("timestamp") or "", (row.get("level") or "INFO").upper(), message))
    return out


def test_csv_of_several_shapes(spark, tmp_path, small_splits):
    write_csv(tmp_path / "a.csv", ["timestamp", "level", "message"],
              [[f"t{i}", ["error", "", "Info"][i % 3], "" if i % 4 == 0 else f' say "{i}", ok '] for i in range(60)])
    write_csv(tmp_path / "b.csv", ["level", "raw_log"], [["warn", "two\nlines"], ["", "one"], ["x", " "]])
    write_csv(tmp_path / "c.csv", ["message", "raw_log", "timestamp"], [["", "from raw", "t"], ["msg", "raw", "u"]])
    got = scan.scan_csv_records(spark, str(tmp_path)).collect()
    want = [r for name in "abc" for r in expected_csv(tmp_path / f"{name}.csv")]
    assert sorted((r.source.rsplit("/", 1)[1], r.line_id, r.timestamp, r.level, r.message) for r in got) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_csv_split_anywhere(spark, tmp_path, small_splits, seed):
    """Line breaks and quotes in fields, many headers, blank lines, rows too short and too long."""
    rnd = random.Random(seed)
    piece = lambda: rnd.choice(["a", "b,", '"', '""', "\n", " ", "é", "\ufffd", "x" * 30, ",", "\n\n", 'say "no"'])
    for name in "abcde":
        header = rnd.sample(["timestamp", "level", "message", "raw_log", "extra, one", 'odd "x"'], rnd.randint(1, 6))
        header += ["message"] * (name == "e")
        rows = [["".join(piece() for _ in range(rnd.randint(0, 6))) for _ in range(max(1, len(header) + rnd.choice([-1, 0, 0, 1])))] for _ in range(rnd.randint(0, 25))]
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            f.write("\n" * rnd.choice([0, 0, 40]))
            out.writerow(header)
            for row in rows:
                out.writerow(row)
                f.write("\n" * rnd.choice([0, 0, 0, 2]))
            # A quote that opens no field, and one that is never closed.
            f.write('5" disk,in 3" bay\n')
            f.write('last,"not closed' * rnd.choice([0, 1]))
    (tmp_path / "none.csv").write_text("\n\n")
    got = scan.scan_csv_records(spark, str(tmp_path)).collect()
    want = [r for name in "abcde" for r in expected_csv(tmp_path / f"{name}.csv")]
    assert sorted((r.source.rsplit("/", 1)[1], r.line_id, r.timestamp, r.level, r.message) for r in got) == sorted(want)


def test_directory_ingest_counts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_text("2026-01-15 12:34:56 ERROR x\n\nplain\n")
    write_csv(tmp_path / "b.csv", ["message"], [["one"], [""], ["two"]])
    (tmp_path / "c.txt").write_text("ignored\n")
    records = scan.scan_directory(spark, str(tmp_path), "now")
    counts = {r.source.rsplit("/", 1)[1]: r.n for r in scan.ingest_counts(records).collect()}
    assert counts == {"a.log": 2, "b.csv": 2}
    rows = {(r.line_id, r.timestamp, r.level, r.message) for r in records.collect()}
    assert (1, "2026-01-15 12:34:56", "ERROR", "x") in rows
    assert (3, "now", "INFO", "plain") in rows


def test_empty_directory_of_csv(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    assert scan.scan_csv_records(spark, str(tmp_path)).count() == 0


def test_profile(spark, tmp_path):
    body = "\n\n a\nb\n\nc\nd\ne\nf\n"
    (tmp_path / "a.log").write_text(body)
    (tmp_path / "b.log").write_text("\n\n")
    rows = {r.file_name: r for r in scan.profile_logs(scan.read_for_profile(spark, str(tmp_path))).collect()}
    a, b = rows["a.log"], rows["b.log"]
    assert (a.total_lines, a.non_empty_lines, a.size_bytes) == (9, 6, len(body))
    assert a.sample_lines == ["a", "b", "c", "d", "e"]
    assert (b.total_lines, b.non_empty_lines, b.sample_lines, b.is_large) == (2, 0, [], False)
    record = scan.profile_record(scan.profile_logs(scan.read_for_profile(spark, str(tmp_path))), "now")
    messages = {r.message for r in record.collect()}
    assert "Perfilado de 'a.log': 9 lineas totales, 6 no vacias, 0.0 KB" in messages
