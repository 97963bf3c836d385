"""The raw-log and incident tables: Parquet, partitioned by a hash bucket of the source.

Appending adds files. Replacing or dropping a source or a run rewrites the buckets that hold
any of its rows, by Spark's dynamic partition overwrite, which leaves all others alone. The
number of buckets is fixed, so a source may have any name or length. One writer at a time is
assumed. An overwrite only touches buckets that it writes rows to, so a rewritten bucket gets
one row marked void, which readers skip: it can be emptied and remembers its largest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from faultline.operators.filters import incidents_of
from faultline.session import cut

BUCKETS = 1024
RAW_COLUMNS = ["id", "line_id", "timestamp", "level", "message", "source", "ts"]
INCIDENT_COLUMNS = [
    "line_id", "raw_log", "clean_log", "level", "event_template", "is_anomaly", "anomaly_score",
    "semantic_cluster", "root_cause", "recommendation", "log_source", "run_id", "created_at",
]
RAW_SCHEMA = (
    "id long, line_id long, timestamp string, level string, message string, ts timestamp_ntz, "
    "source string"
)
INCIDENT_SCHEMA = (
    "line_id long, raw_log string, clean_log string, level string, event_template string, "
    "is_anomaly boolean, anomaly_score double, semantic_cluster int, root_cause string, "
    "recommendation string, created_at timestamp_ntz, log_source string, run_id string"
)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows with their bucket, void ones too; no rows where there is no table yet."""
    schema = f"{schema}, void boolean, bucket int"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _bucket(source: str) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def _with_bucket(rows: DataFrame, source: str) -> DataFrame:
    return rows.withColumns({"void": F.lit(False), "bucket": _bucket(source)})


def _append(rows: DataFrame, path: str, source: str) -> int:
    seen = Observation()
    _write(_with_bucket(rows, source).observe(seen, F.count(F.lit(1)).alias("n")), path, "append")
    return seen.get["n"]


def _rewrite(
    spark: SparkSession, path: str, schema: str, source: str, dropped: DataFrame, new: DataFrame | None = None
) -> int:
    """Drop the rows equal to ``dropped`` in its columns and add the ``new`` ones, in one overwrite.

    ``dropped`` has the column of the source, or ``run_id``, or both; nulls in it equal nothing. Returns how many rows are new.
    Only buckets with rows to drop or to add are read and written again.
    """
    dropped = cut(dropped.distinct())
    stored = _stored(spark, path, schema)
    names = dropped.columns
    same = [F.col(n) == F.col(f"_{n}") for n in names]
    keys = dropped.select(*[F.col(n).alias(f"_{n}") for n in names])
    # The bucket follows from the source: only those can hold rows to drop. There are at most BUCKETS.
    wanted = dropped.select(_bucket(source).alias("bucket")) if source in names else (
        stored.where("not void").join(keys, same, "left_semi").select("bucket"))
    rows = None if new is None else cut(_with_bucket(new, source))
    if rows is not None:
        wanted = wanted.union(rows.select("bucket"))
    buckets = sorted(r.bucket for r in wanted.distinct().collect())
    if not buckets:
        return 0
    touched = stored.where(F.col("bucket").isin(buckets))
    kept = touched.where("not void").join(keys, same, "left_anti")
    # The old rows are written aside first: the overwrite takes the place of the files they come from.
    kept = cut(kept)
    kept = kept if rows is None else kept.unionByName(rows)
    columns = [f.name for f in kept.schema.fields]
    tops = cut(touched.unionByName(kept).groupBy("bucket").agg(F.max(columns[0]).alias(columns[0])))
    every = spark.createDataFrame([(b,) for b in buckets], "bucket int").join(F.broadcast(tops), "bucket", "left")
    filled = {f.name: F.lit(None).cast(f.dataType) for f in kept.schema.fields[1:]} | {"void": F.lit(True), "bucket": F.col("bucket")}
    marks = every.select(columns[0], *[c.alias(n) for n, c in filled.items()])
    _write(kept.unionByName(marks), path, "overwrite")
    return 0 if rows is None else rows.count()


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, RAW_SCHEMA).where("not void").drop("void", "bucket")


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, INCIDENT_SCHEMA).where("not void").drop("void", "bucket")


def _numbered(records: DataFrame, first_id: int) -> DataFrame:
    """Add dense ids from ``first_id`` on: the place in the partition behind all partitions before it."""
    placed = cut(records.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition: small enough to broadcast, so that no record moves.
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead") + F.lit(first_id)
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("id", place).drop("_at", "_part", "_ahead")


def _as_raw(records: DataFrame, first_id: int) -> DataFrame:
    """Fill the defaults of missing columns and values; ids grow with every append."""

    def column(name: str, default):
        if name not in records.columns:
            return F.lit(default)
        return F.coalesce(F.col(name), F.lit(default)) if default is not None else F.col(name)

    stamp = column("timestamp", "")
    level = column("level", "INFO")
    if "id" not in records.columns:
        records = _numbered(records, first_id)
    return records.select(
        F.col("id").cast("long").alias("id"),
        column("line_id", 0).cast("long").alias("line_id"),
        stamp.alias("timestamp"),
        level.alias("level"),
        column("message", "").alias("message"),
        column("source", None).cast("string").alias("source"),
        F.try_to_timestamp(F.replace(stamp, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
        .cast("timestamp_ntz")
        .alias("ts"),
    )


def _start_id(records: DataFrame, path: str, first_id: int | None) -> int:
    """Above every id ever written, dropped ones too."""
    if first_id is not None or "id" in records.columns:
        return first_id or 1
    top = _stored(records.sparkSession, path, RAW_SCHEMA).agg(F.max("id")).first()[0]
    return 1 if top is None else top + 1


def append_raw_logs(records: DataFrame, path: str, first_id: int | None = None) -> int:
    """Append records with defaults for what is missing; returns how many.

    New ids start above the largest one, which is read from the id column alone;
    a caller that knows it can pass ``first_id``, or bring an ``id`` column.
    """
    if records.isEmpty():
        return 0
    return _append(_as_raw(records, _start_id(records, path, first_id)), path, "source")


def replace_sources(records: DataFrame, path: str, first_id: int | None = None) -> int:
    """Write the records in place of everything their sources held before; those without a source are added."""
    if records.isEmpty():
        return 0
    rows = _as_raw(records, _start_id(records, path, first_id))
    dropped = records.select(F.col("source").cast("string").alias("source"))
    return _rewrite(records.sparkSession, path, RAW_SCHEMA, "source", dropped, rows)


def clear_source(spark: SparkSession, path: str, source: str) -> int:
    """Drop one source; returns how many rows it had."""
    n = read_raw_logs(spark, path).where(F.col("source") == source).count()
    if n:
        _rewrite(spark, path, RAW_SCHEMA, "source", spark.createDataFrame([(source,)], "source string"))
    return n


def write_incidents(incidents: DataFrame, path: str) -> int:
    """Write complete incident rows in place of earlier ones of the same source and run."""
    spark = incidents.sparkSession
    rows = incidents.select(*[F.col(f.name).cast(f.dataType) for f in _empty(spark, INCIDENT_SCHEMA).schema.fields])
    return _rewrite(spark, path, INCIDENT_SCHEMA, "log_source", rows.select("log_source", "run_id"), rows)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def save_incidents(
    logs: DataFrame, path: str, log_source: str = "unknown", run_id: str | None = None,
    raw_path: str | None = None,
) -> int:
    """Store the incidents of a run in place of all earlier runs of its source.

    Without incidents nothing is written or deleted. Runs of the source "unknown"
    are kept side by side. Raw lines of the source go as well.
    """
    spark = logs.sparkSession
    incidents = incidents_of(logs)
    if incidents.isEmpty():
        return 0
    run = run_id or "unknown"
    created = F.col("created_at") if "created_at" in logs.columns else F.current_timestamp()
    clean = F.col("clean_log") if "clean_log" in logs.columns else F.col("raw_log")
    rows = (
        incidents.withColumn("clean_log", clean)
        .withColumn("log_source", F.lit(log_source))
        .withColumn("run_id", F.lit(run))
        .withColumn("created_at", created.cast("timestamp_ntz"))
        .select(
            *[F.col(f.name).cast(f.dataType) for f in _empty(spark, INCIDENT_SCHEMA).schema.fields]
        )
    )
    keep_earlier = not log_source or log_source == "unknown"
    if keep_earlier:
        saved = _append(rows, path, "log_source")
    else:
        dropped = spark.createDataFrame([(log_source,)], "log_source string")
        saved = _rewrite(spark, path, INCIDENT_SCHEMA, "log_source", dropped, rows)
    if raw_path and not keep_earlier:
        clear_source(spark, raw_path, log_source)
    return saved


def delete_run(spark: SparkSession, path: str, run_id: str) -> int:
    """Drop the rows of one run in every source; returns in how many sources it had any."""
    rows = read_incidents(spark, path).where(F.col("run_id") == run_id)
    n = rows.agg(F.count_distinct(F.coalesce("log_source", F.lit("")))).first()[0]
    if n:
        _rewrite(spark, path, INCIDENT_SCHEMA, "log_source", spark.createDataFrame([(run_id,)], "run_id string"))
    return n


def restore_run(incidents: DataFrame, run_id: str) -> DataFrame:
    """The rows of one run in line order, ready for the summary operators."""
    rows = incidents.where(F.col("run_id") == run_id)
    clean = F.col("raw_log")
    if "clean_log" in rows.columns:
        clean = F.coalesce(F.col("clean_log"), F.col("raw_log"))
    return (
        rows.withColumn("clean_log", clean)
        .withColumn("is_anomaly", F.col("is_anomaly").cast("boolean"))
        .orderBy("line_id", "log_source")
    )
