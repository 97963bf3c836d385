"""The registered queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline import fixed
from faultline.catalog import fixtures as fx
from faultline.functions.levels import (
    level_anywhere,
    parse_header,
    parse_strict as strict_parts,
    severity_label,
    strict_match,
)
from faultline.functions.rules import recommended_action, rule_cause, rule_family
from faultline.functions.text import clean, leaf_key, mask, masked_line, tokens, truncate
from faultline.operators import (
    centroids,
    clusters,
    density,
    diagnosis,
    features,
    filters,
    history,
    neighbours,
    quality,
    similarity,
    summaries,
    trend,
)
from faultline.plans import run as whole
from faultline.session import cut, scratch_path
from faultline.sources import ingest, reports, scan, tables


# --- Sources and sinks --------------------------------------------------------


def _log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The log lines as text files whose path order is the line order."""
    path = scratch_path(spark, "log")
    lines = fx.logs(spark, sf_dir)
    lines.repartitionByRange("line_id").sortWithinPartitions("line_id").select("raw_log").write.text(path)
    return path


def scan_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan.scan_lines(spark, _log_folder(spark, sf_dir), "*.txt", as_one_log=True)
    return lines.select("line_id", "raw_log")


def profile_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _log_folder(spark, sf_dir)
    lines = scan.read_for_profile(spark, folder, "*.txt", log_name="events.log")
    return scan.profile_logs(lines).select(
        "file_name", "size_bytes", "size_mb", "total_lines", "non_empty_lines", "is_large",
        F.array_join("sample_lines", "\n").alias("sample_lines"),
    )


def parse_header_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = parse_header(F.col("raw_log"), F.lit(fx.INGEST_TS))
    return fx.logs(spark, sf_dir).select("line_id", *[v.alias(k) for k, v in parts.items()])


def parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict lines: the time, the level and the message, without the date."""
    lines = fx.logs(spark, sf_dir).select("line_id", F.substring("raw_log", 12, 1 << 30).alias("line"))
    parts = strict_parts(F.col("line"))
    return lines.where(strict_match(F.col("line"))).select(
        "line_id", *[v.alias(k) for k, v in parts.items()]
    )


def _named_source(records: DataFrame) -> DataFrame:
    return records.withColumn("source", F.regexp_extract("source", "log_source=([^/]+)", 1))


def csv_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    rows = fx.raw_logs(spark, sf_dir)
    (
        rows.select("timestamp", "level", "message", F.col("source").alias("log_source"))
        .write.partitionBy("log_source")
        .option("header", "true")
        .option("escape", '"')
        .csv(path)
    )
    records = _named_source(scan.scan_csv_records(spark, path))
    # Each source is one file or more; its records are numbered from 1 in each of them.
    numbered = records.groupBy("source").agg(F.min("line_id").alias("first_line"))
    return records.select("source", "timestamp", "level", "message").join(F.broadcast(numbered), "source")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ingest")
    rows = fx.logs(spark, sf_dir)
    rows.select("raw_log", "log_source").write.partitionBy("log_source").text(path)
    records = scan.scan_log_records(spark, path, fx.INGEST_TS, "*.txt")
    return scan.ingest_counts(_named_source(records))


def directory_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files (sources 0 and 1) and CSV files (2 and 3), ingested twice into a table.

    Rows of each source by status, with what the table then holds; files of one source are added up.
    """
    path, table = scratch_path(spark, "dir"), scratch_path(spark, "raw")
    rows = fx.logs(spark, sf_dir).select("raw_log", "log_source")
    text = F.col("log_source").isin("src0.log", "src1.log")
    rows.where(text).write.partitionBy("log_source").text(f"{path}/text")
    rows.where(~text).write.partitionBy("log_source").option("header", "true").option("escape", '"').csv(f"{path}/csv")
    for _ in range(2):
        files = ingest.ingest_directory(spark, path, table, fx.INGEST_TS, logs="*.txt")
    files = _named_source(files).groupBy("source", "status").agg(F.sum("n").alias("n"))
    stored = _named_source(tables.read_raw_logs(spark, table)).groupBy("source").agg(
        F.count(F.lit(1)).alias("stored"), F.count_distinct("message").alias("messages"), F.min("level").alias("least_level")
    )
    return files.join(stored, "source")


def _with_ids(rows: DataFrame) -> DataFrame:
    """Rows with the number of ids that differ and the span of the ids, which are one without gaps."""
    ids = rows.agg(F.count_distinct("id").alias("n_ids"), (F.max("id") - F.min("id") + 1).alias("id_span"))
    return rows.drop("id").crossJoin(F.broadcast(ids))


def raw_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    tables.append_raw_logs(fx.raw_logs(spark, sf_dir).drop("id"), path)
    return _with_ids(tables.read_raw_logs(spark, path).select(
        "id", "line_id", "timestamp", "level", "message", "source", "ts"
    ))


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    records = fx.raw_logs(spark, sf_dir).drop("id")
    tables.replace_sources(records, path)
    tables.replace_sources(records, path)
    return _with_ids(tables.read_raw_logs(spark, path).select(
        "id", "line_id", "timestamp", "level", "message", "source"
    ))


def clear_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw")
    tables.append_raw_logs(fx.raw_logs(spark, sf_dir).drop("id"), path)
    tables.clear_source(spark, path, "src0.log")
    return tables.read_raw_logs(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_STORED = [
    "line_id", "raw_log", "level", "event_template", "is_anomaly", "anomaly_score",
    "semantic_cluster", "root_cause", "recommendation", "log_source", "run_id", "created_at",
]


def incidents_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "incidents")
    rows = cut(fx.diagnosed(spark, sf_dir))
    tables.save_incidents(rows, path, "events.log", "run_a")
    tables.save_incidents(rows, path, "events.log", "run_b")
    return tables.read_incidents(spark, path).select(*_STORED)


def _incident_table(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "incidents")
    tables.write_incidents(fx.incidents(spark, sf_dir).drop("severity_label"), path)
    return path


def delete_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _incident_table(spark, sf_dir)
    tables.delete_run(spark, path, "run_1")
    return tables.read_incidents(spark, path).select(*_STORED)


def restore_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tables.read_incidents(spark, _incident_table(spark, sf_dir))
    return tables.restore_run(stored, "run_0").select(*_STORED, "clean_log")


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    rows = reports.report_rows(fx.incidents(spark, sf_dir), "run_0").select(
        "line_id", "level", "event_template", "root_cause", "recommendation", "log_source", "run_id"
    )
    reports.write_report(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


def alert_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alert_export(fx.diagnosed(spark, sf_dir))


def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_stats(fx.scored(spark, sf_dir))


def report_alerts_top150(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_alerts(fx.diagnosed(spark, sf_dir), 150)


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from the report document."""
    document = reports.json_report(
        fx.diagnosed(spark, sf_dir), "run_0", "events.log", fx.INGEST_TS
    )

    def field(path: str):
        return F.get_json_object("report", path)

    alerts = F.from_json(field("$.top_alerts"), "array<struct<line_id:bigint,anomaly_score:double>>")
    return document.select(
        field("$.metadata.run_id").alias("run_id"),
        field("$.stats.total_lines").cast("bigint").alias("total_lines"),
        field("$.stats.severity_counts.ERROR").cast("bigint").alias("n_error"),
        field("$.executive_summary.domain").alias("domain"),
        F.array_join(F.transform(alerts, lambda a: a["line_id"].cast("string")), ",").alias("alert_lines"),
        F.element_at(alerts, 1)["anomaly_score"].alias("top_score"),
    )


# --- Projections --------------------------------------------------------------


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", clean(F.col("text")).alias("clean"))


def mask_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logs(spark, sf_dir).select("line_id", mask(F.col("raw_log")).alias("masked"))


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents")
    return documents.select("doc_id", mask(F.col("text")).alias("masked"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.size(tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


def truncate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents")
    return documents.select("doc_id", truncate(F.col("text")).alias("text"))


def parse_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.logs(spark, sf_dir).select(
        F.lit("logs").alias("origin"), F.col("line_id").alias("id"), F.col("raw_log").alias("text")
    )
    documents = fx.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    return lines.unionByName(documents).select(
        "origin", "id", level_anywhere(F.col("text")).alias("level")
    )


def severity_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scored(spark, sf_dir).select("line_id", severity_label(F.col("level")).alias("severity_label"))


def drain_leaf_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.logs(spark, sf_dir).select("line_id", leaf_key(masked_line(F.col("raw_log"))).alias("leaf"))


def root_cause_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.parsed(spark, sf_dir).select(
        "line_id",
        rule_cause(F.col("event_template")).alias("root_cause"),
        rule_family(F.col("event_template")).alias("cause_family"),
    )


def recommend_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.parsed(spark, sf_dir)
    return rows.select(
        "line_id", recommended_action(rule_cause(F.col("event_template"))).alias("recommendation")
    )


# --- Filters and searches -------------------------------------------------------


def incident_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.incidents_of(fx.scored(spark, sf_dir)).select("line_id", "level", "is_anomaly")


def alert_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.alerts_of(fx.scored(spark, sf_dir)).select("line_id", "level", "is_anomaly")


def search_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search_level(fx.raw_logs(spark, sf_dir), "error")


def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search_keyword(fx.raw_logs(spark, sf_dir), "CONNECTION")


def search_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.search_incidents(fx.incidents(spark, sf_dir), "red")
    return found.select("line_id", "raw_log", "root_cause", "recommendation", "log_source", "created_at")


def explorer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.explorer_search(fx.parsed(spark, sf_dir), "TIMEOUT|killed by|login attempt")
    return found.select("line_id", "raw_log", "level")


def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.scored(spark, sf_dir)
    found = filters.explorer_filter(rows, ["ERROR", "CRITICAL", "WARNING"], [0, 1, 2], True, 1000)
    return found.select("line_id", "level", "semantic_cluster", "is_anomaly")


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.get_by_id(fx.raw_logs(spark, sf_dir), 7)


def list_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.list_logs(fx.raw_logs(spark, sf_dir), "src2.log")


def list_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.list_incidents(fx.incidents(spark, sf_dir))
    return rows.select("line_id", "level", "event_template", "root_cause", "created_at")


def list_run_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.list_incidents(fx.incidents(spark, sf_dir), "run_2")
    return rows.select("line_id", "level", "event_template", "root_cause", "run_id")


def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.facet_values(fx.scored(spark, sf_dir))


def count_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.count_logs(fx.raw_logs(spark, sf_dir), "src1.log")


# --- Aggregates -----------------------------------------------------------------


def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = summaries.incident_summary(fx.incidents(spark, sf_dir))
    pairs = F.transform(
        F.array_sort(F.map_entries("severity_counts")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return row.withColumn("severity_counts", F.array_join(pairs, ","))


def _of_diagnosed(operator, *args):
    return lambda spark, sf_dir: operator(fx.diagnosed(spark, sf_dir), *args)


def _of_parsed(operator, *args):
    return lambda spark, sf_dir: operator(fx.parsed(spark, sf_dir), *args)


def _of_scored(operator, *args):
    return lambda spark, sf_dir: operator(fx.scored(spark, sf_dir), *args)


def _of_incidents(operator, *args):
    return lambda spark, sf_dir: operator(fx.incidents(spark, sf_dir), *args)


def cluster_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.cluster_heatmap(fx.scored(spark, sf_dir), 3)


def risk_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trend.risk_trend(fx.scored(spark, sf_dir), ["log_source"])
    return rows.select(
        "log_source",
        "line_id",
        *[F.round(c, 6).alias(c) for c in ("smoothed_risk", "normalized_risk", "low_band", "high_band")],
    )


def risk_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.parsed(spark, sf_dir)
    peaks = summaries.risk_peaks(rows, trend.risk_trend(rows, ["log_source"]), ["log_source"])
    return peaks.withColumn("normalized_risk", F.round("normalized_risk", 6))


def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.semantic_candidates(fx.parsed(spark, sf_dir))


# --- Features and models ----------------------------------------------------------


def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.numeric_features(fx.parsed(spark, sf_dir)).select("line_id", *features.NUMERIC)


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.scaled_features(features.numeric_features(fx.parsed(spark, sf_dir)))
    return rows.select("line_id", *[F.round(f"{c}_scaled", 6).alias(c) for c in features.NUMERIC])


def _row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.parsed(spark, sf_dir)
    return cut(features.distinct_texts(rows, F.col("event_template"), F.col("line_id")))


def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = features.fit_vocabulary(_row_texts(spark, sf_dir), fixed.TFIDF_ROW_TERMS)
    return vocabulary.select("term", "total", "df", F.round("idf", 6).alias("idf"))


def _weights(texts: DataFrame, max_terms: int) -> DataFrame:
    vocabulary = cut(features.fit_vocabulary(texts, max_terms))
    weights = features.long_form(features.vectorize(texts, vocabulary), vocabulary)
    return weights.withColumn("weight", F.round("weight", 6))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_row_texts(spark, sf_dir), fixed.TFIDF_ROW_TERMS)


def _distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_texts(spark, sf_dir).withColumn("m", F.lit(1).cast("bigint"))


def tfidf_384(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_distinct_texts(spark, sf_dir), fixed.TFIDF_SEMANTIC_TERMS)


def diagnose_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.diagnosed(spark, sf_dir)
    return rows.select("line_id", "root_cause", "recommendation", "severity_label")


def diagnose_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = diagnosis.alert_texts(fx.parsed(spark, sf_dir))
    rows = diagnosis.diagnose_by_similarity(texts, 0.1)
    return rows.withColumn("best_score", F.round("best_score", 6))


def diagnose_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnosis.generate_alerts(fx.parsed(spark, sf_dir))
    return rows.select("line_id", "root_cause", "recommendation", "severity_label")


def semantic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of its template (by its first line) on every row."""
    rows = fx.parsed(spark, sf_dir)
    every = features.semantic_candidates(rows)
    labels = every.select("text", (F.col("first_line") % 8).cast("int").alias("label"))
    return diagnosis.map_semantic(rows, labels).select("line_id", "semantic_cluster")


def semantic_map_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the semantic cluster of its template, however rare."""
    rows = fx.parsed(spark, sf_dir)
    labels = clusters.semantic_clusters(features.semantic_candidates(rows))
    return diagnosis.map_semantic(rows, labels).select("line_id", "semantic_cluster")


def _semantic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _distinct_texts(spark, sf_dir)
    vocabulary = cut(features.fit_vocabulary(texts, fixed.TFIDF_SEMANTIC_TERMS))
    return cut(features.vectorize(texts, vocabulary).withColumnRenamed("first_line", "vec_id"))


def cosine_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.cosine_neighbors(_semantic_vectors(spark, sf_dir), fixed.SEMANTIC_EPS)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = whole.template_vectors(fx.parsed(spark, sf_dir))
    return density.dbscan(vectors).join(vectors.select("vec_id", "text", "m"), "vec_id")


def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.semantic_clusters(features.semantic_candidates(fx.parsed(spark, sf_dir)))


def semantic_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = features.semantic_candidates(fx.parsed(spark, sf_dir))
    return clusters.semantic_clusters(candidates, method="kmeans")


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, vocabulary = whole.template_vectors(fx.parsed(spark, sf_dir))
    labels, _ = clusters.statistical_clusters(vectors, vocabulary.count(), "kmeans")
    return labels.join(vectors.select("vec_id", "text", "m"), "vec_id")


def svd_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, vocabulary = whole.template_vectors(fx.parsed(spark, sf_dir))
    basis = centroids.svd_basis(vectors, vocabulary.count(), fixed.SVD_COMPONENTS)
    return centroids.svd_project(vectors.select("vec_id", "vec"), basis).select("vec_id", "reduced")


def _labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.parsed(spark, sf_dir)
    vectors, _ = whole.template_vectors(rows)
    sizes = rows.groupBy(F.col("event_template").alias("text"), F.col("semantic_cluster").alias("label")).agg(
        F.count(F.lit(1)).alias("m")
    )
    return cut(vectors.select("vec_id", "text", "vec").join(sizes, "text").drop("text"))


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = quality.silhouette(_labelled_points(spark, sf_dir))
    return row.withColumn("silhouette", F.round("silhouette", 6))


def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = quality.davies_bouldin(_labelled_points(spark, sf_dir))
    return row.withColumn("davies_bouldin", F.round("davies_bouldin", 6))


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(fx.parsed(spark, sf_dir).drop("is_anomaly", "anomaly_score"))
    vectors, vocabulary = whole.template_vectors(rows)
    scored = whole.with_anomalies(rows, vectors, vocabulary.count())
    return scored.select("line_id", "level", "is_anomaly", "anomaly_score")


def drain_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = whole.parse(fx.logs(spark, sf_dir))
    return mined.select("log_source", "line_id", "level", "event_id", "event_template")


def drain_hot_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every leaf of more than 200 lines mined by ranges of lines."""
    mined = whole.parse(fx.logs(spark, sf_dir), hot_rows=200)
    return mined.select("log_source", "line_id", "level", "event_id", "event_template")


def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fx.table(spark, sf_dir, "embeddings")
    query = vectors.orderBy("vec_id").first()["embedding"]
    top = similarity.most_similar(vectors, query, 10)
    return top.withColumn("score", F.round("score", 6))


def most_similar_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every one whose id is divisible by 50, among all."""
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = similarity.most_similar_batch(asked, vectors, 10)
    return found.withColumn("score", F.round("score", 6))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = similarity.mean_pool(fx.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("position", "x")).withColumn(
        "x", F.round("x", 6)
    )


def _hash_embedder(texts: list[str]):
    """A deterministic stand-in for a language model: hashed word counts."""
    import zlib

    import numpy as np

    out = np.zeros((len(texts), 64))
    for row, text in enumerate(texts):
        for word in text.lower().split():
            out[row, zlib.crc32(word.encode()) % 64] += 1.0
    return out


def embed_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _row_texts(spark, sf_dir)
    return similarity.embed(texts, _hash_embedder).select("text", "m", "embedding")


def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return clusters.semantic_clusters_dense(vectors)


def diagnosis_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run on all lines as one log, up to the diagnosed rows."""
    lines = fx.logs(spark, sf_dir).withColumn("log_source", F.lit("events.log"))
    result = whole.run_on(lines, "events.log")
    return result.logs.select(
        "line_id", "event_id", "event_template", "level", "is_anomaly", "anomaly_score",
        "dbscan_cluster", "semantic_cluster", "root_cause", "recommendation", "severity_label",
    )


def queries() -> dict:
    return {
        "scan_log_lines": scan_log_lines,
        "profile_logs": profile_logs,
        "parse_header": parse_header_query,
        "parse_strict": parse_strict,
        "csv_log_scan": csv_log_scan,
        "ingest_counts": ingest_counts,
        "directory_ingest": directory_ingest,
        "raw_append": raw_append,
        "replace_source": replace_source,
        "clear_source": clear_source,
        "incidents_sink": incidents_sink,
        "delete_run": delete_run,
        "restore_run": restore_run,
        "report_rows": report_rows,
        "alert_export": alert_export,
        "report_stats": report_stats,
        "report_alerts_top150": report_alerts_top150,
        "json_report": json_report,
        "clean_text": clean_text,
        "mask_template": mask_template,
        "mask_documents": mask_documents,
        "token_counts": token_counts,
        "truncate_long": truncate_long,
        "parse_level": parse_level,
        "severity_label": severity_label_query,
        "drain_leaf_key": drain_leaf_key,
        "root_cause_rules": root_cause_rules,
        "recommend_action": recommend_action,
        "incident_filter": incident_filter,
        "alert_filter": alert_filter,
        "search_level": search_level,
        "search_keyword": search_keyword,
        "search_incidents": search_incidents,
        "explorer_search": explorer_search,
        "explorer_filter": explorer_filter,
        "get_by_id": get_by_id,
        "list_logs": list_logs,
        "list_incidents": list_incidents,
        "list_run_incidents": list_run_incidents,
        "facet_values": facet_values,
        "count_logs": count_logs,
        "semantic_map": semantic_map,
        "semantic_map_all": semantic_map_all,
        "diagnose_rules": diagnose_rules,
        "diagnose_semantic": diagnose_semantic,
        "diagnose_rows": diagnose_run_rows,
        "cosine_neighbors": cosine_neighbors,
        "compare_runs": _of_incidents(
            history.compare_runs, ("run_0", "src0.log"), ("run_1", "src1.log")
        ),
        "list_runs": _of_incidents(history.list_runs),
        "recent_runs": _of_incidents(history.recent_runs, 8),
        "history_totals": _of_incidents(history.history_totals),
        "new_templates": _of_incidents(history.new_templates, "run_0", "run_1"),
        "resolved_templates": _of_incidents(history.resolved_templates, "run_0", "run_1"),
        "incident_summary": incident_summary,
        "log_domain": _of_parsed(summaries.log_domain),
        "executive_summary": _of_parsed(summaries.executive_summary),
        "top_templates": _of_parsed(summaries.top_templates, 5),
        "root_cause_summary": _of_diagnosed(summaries.root_cause_summary),
        "pattern_stats": _of_parsed(summaries.pattern_stats),
        "severity_distribution": _of_scored(summaries.severity_distribution),
        "cluster_counts": _of_scored(summaries.cluster_counts),
        "cluster_heatmap": cluster_heatmap,
        "kpi_metrics": _of_scored(summaries.kpi_metrics),
        "risk_index": _of_scored(summaries.risk_index),
        "system_status": _of_scored(summaries.system_status),
        "alert_badge": _of_scored(summaries.alert_badge),
        "alert_severity": _of_scored(summaries.alert_severity),
        "score_range": _of_scored(summaries.score_range),
        "alert_inbox": _of_diagnosed(summaries.alert_inbox),
        "alert_timeline": _of_diagnosed(summaries.alert_timeline),
        "risk_trend": risk_trend,
        "risk_peaks": risk_peaks,
        "semantic_candidates": semantic_candidates,
        "numeric_features": numeric_features,
        "scaled_features": scaled_features,
        "tfidf_terms": tfidf_terms,
        "tfidf_weights": tfidf_weights,
        "tfidf_384": tfidf_384,
        "silhouette": silhouette,
        "davies_bouldin": davies_bouldin,
        "most_similar": most_similar,
        "most_similar_batch": most_similar_batch,
        "mean_pool": mean_pool,
        "drain_templates": drain_templates,
        "drain_hot_leaves": drain_hot_leaves,
        "isolation_forest": isolation_forest,
        "dbscan_clusters": dbscan_clusters,
        "semantic_clusters": semantic_clusters,
        "semantic_kmeans": semantic_kmeans,
        "kmeans_clusters": kmeans_clusters,
        "svd_project": svd_project,
        "embed_templates": embed_templates,
        "embedding_clusters": embedding_clusters,
        "diagnosis_run": diagnosis_run,
    }
