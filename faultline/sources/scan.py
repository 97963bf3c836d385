"""Log and CSV files as DataFrames with physical line numbers.

Lines are numbered without a global window and without moving any line: inside a
file split the position comes from the task itself, and the number of lines
before the split is a prefix sum over the (small) table of splits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from faultline import fixed
from faultline.functions.levels import parse_header
from faultline.functions.text import strip
from faultline.session import cut
from faultline.sources import csv_records

_IN_TASK = (1 << 33) - 1
BROADCAST_SPLITS = 1_000_000


def _pin_splits(spark: SparkSession) -> None:
    """Keep the packing of file splits the same for both passes over the files.

    By default it follows the number of executors, which may change meanwhile.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def _only(splits: DataFrame, whole_files: DataFrame | None, lines: str) -> DataFrame:
    """The splits of the files named in ``whole_files`` (source, lines), which must have that many lines."""
    if whole_files is None:
        return splits
    known = whole_files.select(F.col("source").alias("_file"), F.col("lines").alias("_told"))
    seen = F.sum(lines).over(W.partitionBy("_file"))
    same = F.when(seen == F.col("_told"), F.col(lines)).otherwise(
        F.raise_error(F.concat(F.lit("a file changed or can no longer be read: "), F.col("_file"))).cast("long")
    )
    return splits.join(known, "_file").withColumn(lines, same).drop("_told")


def _number(lines: DataFrame, whole: bool, whole_files: DataFrame | None = None) -> DataFrame:
    """Add ``line_id`` to rows of a file scan that carry ``_file`` and ``_start``.

    ``whole`` numbers all files as one log, in path order. ``whole_files`` leaves out all others.
    """
    placed = lines.withColumn("_task", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))
    )
    splits = placed.groupBy("_file", "_start", "_task").agg(
        F.min("_at").alias("_base"), F.count(F.lit(1)).alias("_n")
    )
    splits = _only(splits, whole_files, "_n")
    scope = W.partitionBy() if whole else W.partitionBy("_file")
    before = scope.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    splits = cut(
        splits.select(
            "_file", "_start", "_task", "_base",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        )
    )
    # One row per file split, a hundred bytes or so each. Up to the limit the lines
    # stay where they are; beyond it the planner picks the join.
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    joined = placed.join(splits, ["_file", "_start", "_task"], "left")
    if whole_files is not None:
        # Splits of the files left out have no row in the table on purpose.
        kept = whole_files.select(F.col("source").alias("_file"))
        joined = joined.join(kept, "_file", "left_semi")
    line_id = F.col("_before") + F.col("_at") - F.col("_base") + 1
    # A split that moved between the passes must not go unnoticed.
    checked = F.coalesce(line_id, F.raise_error(F.lit("file splits changed during the scan")).cast("long"))
    return joined.withColumn("line_id", checked).drop("_task", "_at", "_base", "_before", "_start")


def _valid_text(col: Column) -> Column:
    """Bytes that are not UTF-8 are dropped; valid text stays as it is."""
    repaired = F.replace(F.make_valid_utf8(col), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(col), col).otherwise(repaired)


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def _read_lines(spark: SparkSession, path, glob: str | None, tolerant: bool = False) -> DataFrame:
    """``tolerant`` ends a damaged file at the damage; the caller must leave such files out."""
    _pin_splits(spark)
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(tolerant).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_size"),
    )


def scan_lines(
    spark: SparkSession,
    path,
    glob: str | None = None,
    as_one_log: bool = False,
    whole_files: DataFrame | None = None,
) -> DataFrame:
    """(source, file_name, line_id, raw_log): non-blank lines, stripped.

    ``line_id`` is the physical 1-based line number of the file, so blank lines
    leave gaps. ``source`` is the full file path. ``as_one_log`` numbers the files
    of a directory as the parts of one log. ``whole_files`` (``file_status``) reads only those.
    """
    lines = _number(_read_lines(spark, path, glob, whole_files is not None), as_one_log, whole_files)
    text = strip(_valid_text(F.col("value")))
    return (
        lines.select(
            F.col("_file").alias("source"),
            _file_name(F.col("_file")).alias("file_name"),
            "line_id",
            text.alias("raw_log"),
        )
        .where(F.col("raw_log") != "")
    )


def with_header(lines: DataFrame, ingest_ts: Column | str, extended: bool = False) -> DataFrame:
    """Split ``raw_log`` into timestamp, level and message."""
    stamp = F.lit(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts
    parts = parse_header(F.col("raw_log"), stamp, extended)
    return lines.select("*", *[value.alias(name) for name, value in parts.items()])


def scan_log_records(
    spark: SparkSession, path, ingest_ts: Column | str, glob: str | None = "*.log", whole_files: DataFrame | None = None
) -> DataFrame:
    """Log files as raw-log records: source, line_id, timestamp, level, message."""
    records = with_header(scan_lines(spark, path, glob, whole_files=whole_files), ingest_ts)
    return records.select("source", "line_id", "timestamp", "level", "message")


def scan_csv_records(
    spark: SparkSession, path, glob: str | None = "*.csv", whole_files: DataFrame | None = None
) -> DataFrame:
    """CSV files with a header as raw-log records, one plan for any number of files and headers.

    The message is the ``message`` column, else ``raw_log``; rows without one are
    dropped, but still counted in ``line_id`` (the 1-based data row). Of columns with one name
    the last counts, missing ones are empty. Files are split, also where quoted fields hold line breaks.
    """
    lines = _read_lines(spark, path, glob, whole_files is not None).select(
        "_file", "_start", _valid_text(F.col("value")).alias("value")
    )
    splits = _only(csv_records.split_table(lines), whole_files, "lines")
    near = splits.count() <= BROADCAST_SPLITS
    found = csv_records.records(lines, splits, near)
    # One header a file, at the first split that holds one or in the pieces of a longer one.
    first = splits.where("header is not null").select("_file", "header").unionByName(
        found.where("number = 1").select("_file", F.col("fields").alias("header"))
    )
    headers = cut(first.dropDuplicates(["_file"]))
    rows = found.where("number > 1").join(F.broadcast(headers) if near else headers, "_file")

    def column(name: str) -> Column:
        place = F.size("header") - F.array_position(F.reverse("header"), F.lit(name))
        missing = F.array_position("header", F.lit(name)) == 0
        return F.when(missing, F.lit("")).otherwise(F.coalesce(F.get("fields", place.cast("int")), F.lit("")))

    message = strip(F.coalesce(F.nullif(column("message"), F.lit("")), column("raw_log")))
    level = F.upper(F.coalesce(F.nullif(column("level"), F.lit("")), F.lit("INFO")))
    return rows.select(
        F.col("_file").alias("source"), (F.col("number") - 1).alias("line_id"),
        column("timestamp").alias("timestamp"), level.alias("level"), message.alias("message"),
    ).where(F.col("message") != "")


def file_status(spark: SparkSession, path, glob: str) -> DataFrame:
    """(source, status, lines) of every file: whole, or failed if its bytes can't all be read.

    ``lines`` counts what a scan takes for lines. The names come from the scan's own list of files.
    A reader that ends at the first damage is measured: the lines and their ends must
    be as long as the file. It leaves out a byte order mark of three bytes.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    lines = reader.option("lineSep", "\n").option("ignoreCorruptFiles", "true").text(path)
    # Empty files too; the metadata write a path without an authority with one slash.
    names = [(re.sub(r"^(\w+:)///", r"\1/", f),) for f in lines.inputFiles()]
    files = spark.createDataFrame(names, "source string")
    sizes = reader.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("size")
    )
    # A scan also ends lines at carriage returns that no line feed follows.
    inner = F.regexp_replace("value", "\r$", "")
    returns = F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit("\r"), F.lit("")))
    read = lines.groupBy(F.col("_metadata.file_path").alias("source")).agg(
        F.sum(F.octet_length("value") + 1).alias("read"), F.sum(returns + 1).alias("lines")
    )
    missing = F.coalesce("size", F.lit(0)) - F.coalesce("read", F.lit(0))
    # No end behind the last line: one byte less than counted.
    status = F.when(missing.isin(-1, 0, 2, 3), "whole").otherwise("failed")
    return files.join(sizes, "source", "left").join(read, "source", "left").select(
        "source", status.alias("status"), F.coalesce("lines", F.lit(0)).alias("lines")
    )


def directory_status(spark: SparkSession, path, logs: str = "*.log", tables: str = "*.csv") -> DataFrame:
    """``file_status`` of all log and CSV files below a directory."""
    return file_status(spark, path, f"{{{logs},{tables}}}")


def scan_directory(
    spark: SparkSession, path, ingest_ts: Column | str, status: DataFrame | None = None,
    logs: str = "*.log", tables: str = "*.csv",
) -> DataFrame:
    """All log and CSV files below a directory, by the patterns of their names, as raw-log records.

    A file that can't be read whole, by ``status`` (``directory_status``), is left out whole
    and does not stop the others. One that can no longer be read as it was then is an error.
    """
    status = cut(directory_status(spark, path, logs, tables)) if status is None else status
    whole = status.where("status = 'whole' and lines > 0").select("source", "lines")
    records = scan_log_records(spark, path, ingest_ts, logs, whole)
    return records.unionByName(scan_csv_records(spark, path, tables, whole))


def ingest_counts(records: DataFrame) -> DataFrame:
    """Records per file: what an ingest would insert, without writing anything."""
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def read_for_profile(
    spark: SparkSession, path, glob: str | None = None, log_name: str | None = None
) -> DataFrame:
    """All physical lines, blank ones too, with the size of their file.

    With ``log_name`` all files count as the parts of one log of that name.
    """
    lines = _number(_read_lines(spark, path, glob), whole=log_name is not None)
    file = F.col("_file")
    return lines.select(
        (F.lit(log_name) if log_name else file).alias("source"),
        (F.lit(log_name) if log_name else _file_name(file)).alias("file_name"),
        file.alias("file"),
        F.col("_size").alias("size_bytes"),
        "line_id",
        strip(_valid_text(F.col("value"))).alias("raw_log"),
    )


def profile_logs(lines: DataFrame, first: int = 5) -> DataFrame:
    """Line counts, size and first lines per log, from ``read_for_profile``.

    Only the stretch of lines that holds the first non-blank ones is gathered, so
    the list per log stays short whatever the size of the log.
    """
    useful = F.col("raw_log") != ""
    stretch = F.floor(F.col("line_id") / 4096)
    per_stretch = (
        lines.groupBy("source", "file_name", "file", stretch.alias("stretch"))
        .agg(
            F.max("size_bytes").alias("size_bytes"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(useful).alias("useful"),
        )
    )
    counts = (
        per_stretch.groupBy("source", "file_name", "file")
        .agg(
            F.max("size_bytes").alias("size_bytes"),
            F.sum("total").alias("total"),
            F.sum("useful").alias("useful"),
        )
        .groupBy("source", "file_name")
        .agg(
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("total").alias("total_lines"),
            F.sum("useful").alias("non_empty_lines"),
        )
    )
    ahead = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    wanted = (
        per_stretch.where(F.col("useful") > 0)
        .groupBy("source", "stretch")
        .agg(F.sum("useful").alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .where(F.col("ahead") < first)
        .select("source", "stretch")
    )
    samples = (
        lines.where(useful)
        .withColumn("stretch", stretch)
        .join(wanted, ["source", "stretch"], "left_semi")
        .groupBy("source")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("line_id", "raw_log"))), 1, first).alias("s"))
        .select("source", F.col("s.raw_log").alias("sample_lines"))
    )
    return (
        counts.join(samples, "source", "left")
        .withColumn("sample_lines", F.coalesce("sample_lines", F.array().cast("array<string>")))
        .withColumn("size_mb", F.bround(F.col("size_bytes") / (1024 * 1024), 2))
        .withColumn("is_large", F.col("non_empty_lines") > fixed.LARGE_LOG_ROWS)
    )


def profile_record(profile: DataFrame, ingest_ts: Column | str) -> DataFrame:
    """The profile of each file as an INFO record of source ``profile``."""
    stamp = F.lit(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts
    message = F.concat(
        F.lit("Perfilado de '"), "file_name", F.lit("': "),
        F.col("total_lines").cast("string"), F.lit(" lineas totales, "),
        F.col("non_empty_lines").cast("string"), F.lit(" no vacias, "),
        F.bround(F.col("size_bytes") / 1024, 1).cast("string"), F.lit(" KB"),
    )
    return profile.select(
        F.lit("profile").alias("source"),
        F.lit(0).cast("long").alias("line_id"),
        stamp.alias("timestamp"),
        F.lit("INFO").alias("level"),
        message.alias("message"),
    )
