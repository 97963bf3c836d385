"""Directory ingest: damaged files fail as a whole, the others are written."""

import pytest

from faultline.sources import ingest, scan, tables


@pytest.fixture
def folder(spark, tmp_path):
    """Whole files of both kinds, and one of each kind whose bytes do not match their checksums."""
    path = tmp_path / "in"
    (path / "sub").mkdir(parents=True)
    (path / "sub" / "a [1] b%20c.log").write_bytes(b"\xef\xbb\xbf2026-01-15 12:34:56 ERROR x\r\n\r\nplain")
    (path / "b{2}.csv").write_text("message\none\n\"\"\ntwo\n")
    (path / "empty.log").write_text("")
    (path / "c.txt").write_text("ignored\n")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileSystem.getLocal(spark._jsc.hadoopConfiguration())
    for name, body in (("bad.log", "".join(f"line {i}\n" for i in range(20000))),
                       ("bad.csv", "message\n" + "".join(f"row {i}\n" for i in range(20000)))):
        out = files.create(hadoop.Path(f"{path}/{name}"))
        out.write(bytearray(body.encode()))
        out.close()
        damaged = bytearray((path / name).read_bytes())
        damaged[130000] ^= 1
        (path / name).write_bytes(damaged)
    return str(path)


def named(rows):
    return {r.source.rsplit("/", 1)[1]: (r.status, r.n) for r in rows.collect()}


WANT = {"a%20%5B1%5D%20b%2520c.log": ("whole", 2), "b%7B2%7D.csv": ("whole", 2), "empty.log": ("whole", 0),
        "bad.log": ("failed", 0), "bad.csv": ("failed", 0)}


def test_damaged_files_are_left_out_whole(spark, folder):
    counts = {r.source.rsplit("/", 1)[1]: r.n for r in scan.ingest_counts(scan.scan_directory(spark, folder, "now")).collect()}
    assert counts == {k: n for k, (_, n) in WANT.items() if n}


def test_dry_run_counts_and_a_run_replaces(spark, folder, tmp_path):
    table = str(tmp_path / "table")
    assert named(ingest.ingest_directory(spark, folder, table, "now", dry_run=True)) == WANT
    assert tables.read_raw_logs(spark, table).count() == 0
    for _ in range(2):
        assert named(ingest.ingest_directory(spark, folder, table, "now")) == WANT
        rows = {(r.line_id, r.level, r.message) for r in tables.read_raw_logs(spark, table).collect()}
        assert rows == {(1, "ERROR", "x"), (3, "INFO", "plain"), (1, "INFO", "one"), (3, "INFO", "two")}
        assert tables.read_raw_logs(spark, table).count() == 4


def test_a_damaged_file_is_no_silent_loss_in_a_plain_scan(spark, folder):
    with pytest.raises(Exception, match="(?i)checksum|FAILED_READ_FILE"):
        scan.ingest_counts(scan.scan_log_records(spark, folder, "now")).collect()
