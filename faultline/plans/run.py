"""A whole diagnosis run: scan, mine, score, cluster, diagnose, store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline import fixed
from faultline.functions.text import clean
from faultline.operators.clusters import (
    attach_statistical_label,
    semantic_clusters,
    semantic_clusters_dense,
    statistical_clusters,
)
from faultline.operators.diagnosis import generate_alerts, map_semantic
from faultline.operators.features import (
    NUMERIC,
    distinct_texts,
    fit_vocabulary,
    numeric_features,
    row_features,
    scaled_features,
    semantic_candidates,
    vectorize,
)
from faultline.operators.forest import detect, fit_forest, sample_rows, score_forest
from faultline.operators.lookup import lookup
from faultline.operators.quality import davies_bouldin, silhouette
from faultline.operators.similarity import embed
from faultline.operators.templates import HOT_ROWS, mine_templates
from faultline.session import cut, spread
from faultline.sources.scan import profile_logs, profile_record, read_for_profile, scan_lines, with_header
from faultline.sources.tables import append_raw_logs, replace_sources, save_incidents

_GROUP = ["event_template", *NUMERIC]


@dataclass
class RunResult:
    logs: DataFrame
    run_id: str
    log_source: str
    profile: DataFrame | None
    saved_incidents: int
    statistical_backend: str
    semantic_backend: str
    silhouette_score: float
    davies_bouldin_index: float
    persistence_error: str | None = None


def parse(logs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Clean the raw lines and mine their templates."""
    dealt = spread(logs, "log_source", "line_id", "raw_log")
    return mine_templates(dealt.withColumn("clean_log", clean(F.col("raw_log"))), hot_rows=hot_rows)


def template_vectors(logs: DataFrame, max_terms: int = fixed.TFIDF_ROW_TERMS):
    """Distinct templates with vec_id (first line), m and vec, and the vocabulary.

    The fit is over rows: a template counts as often as it occurs.
    """
    texts = cut(
        distinct_texts(logs, F.coalesce(F.col("event_template"), F.lit("")), F.col("line_id"))
    )
    vocabulary = cut(fit_vocabulary(texts, max_terms))
    vectors = cut(vectorize(texts.withColumnRenamed("first_line", "vec_id"), vocabulary))
    return vectors, vocabulary


def _on_group(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on equal features; rows without a template match each other too."""
    same = F.lit(True)
    for name in _GROUP:
        same = same & left[name].eqNullSafe(right[name])
    return left.join(right, same)


def group_verdicts(
    rows: DataFrame,
    groups: DataFrame,
    vectors: DataFrame,
    width: int,
    contamination: float = fixed.CONTAMINATION,
    keys: tuple[str, ...] = ("log_source", "line_id"),
    trees: int = fixed.FOREST_TREES,
    subsample: int = fixed.FOREST_SUBSAMPLE,
) -> DataFrame:
    """Distinct feature rows with is_anomaly and anomaly_score.

    Rows with equal features score alike, so the forest sees each distinct feature
    row of ``groups`` once; its number of rows, ``m``, is the weight in the scaling and the
    percentile. ``rows`` has the keys and the features of every row; the training sample is drawn from it.
    """
    features = (
        scaled_features(groups, "m")
        .withColumn("_key", F.coalesce(F.col("event_template"), F.lit("")))
        .join(vectors.select(F.col("text").alias("_key"), "vec"), "_key")
        .select("*", F.array(*[F.col(f"{c}_scaled") for c in NUMERIC]).alias("numeric"))
        .drop("_key")
    )
    features = cut(features.select(*_GROUP, "m", "vec", "numeric"))
    # A fixed-size sample: at most trees x subsample rows.
    sample = cut(sample_rows(rows.select(*keys, *_GROUP), list(keys), trees * subsample, fixed.SEED))
    drawn = cut(
        _on_group(features, sample).select(*[sample[k] for k in keys], "vec", "numeric")
    )
    model = fit_forest(drawn, list(keys), width, trees)
    per_tree = min(subsample, drawn.count())
    scored = cut(score_forest(features, model, width, per_tree).drop("vec", "numeric"))
    return detect(scored, "m", contamination).drop("m")


def with_anomalies(
    logs: DataFrame,
    vectors: DataFrame,
    width: int,
    contamination: float = fixed.CONTAMINATION,
    keys: tuple[str, ...] = ("log_source", "line_id"),
    trees: int = fixed.FOREST_TREES,
    subsample: int = fixed.FOREST_SUBSAMPLE,
) -> DataFrame:
    """Add is_anomaly and anomaly_score from the forest."""
    rows = numeric_features(logs)
    # What the forest needs of a row is written once, not worked out for each of its uses.
    narrow = cut(rows.select(*keys, *_GROUP))
    groups = cut(narrow.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("m")))
    verdicts = group_verdicts(narrow, groups, vectors, width, contamination, keys, trees, subsample)
    extra = [verdicts["is_anomaly"], verdicts["anomaly_score"]]
    kept = [rows[c] for c in rows.columns if c not in NUMERIC]
    return _on_group(rows, verdicts).select(*kept, *extra)


def semantic_labels(
    candidates: DataFrame, encode: Callable[[list[str]], object] | None = None
) -> tuple[DataFrame, str]:
    """(text, label) of the templates and the backend; an embedder that fails falls back to TF-IDF."""
    backend = "tfidf"
    if encode is not None:
        try:
            embedded = cut(
                embed(candidates.withColumnRenamed("first_line", "vec_id"), encode)
            )
            labels = semantic_clusters_dense(embedded.select("vec_id", "embedding"))
            return cut(embedded.join(labels, "vec_id").select("text", "label")), "embedder"
        except PythonException:
            # Only a fault of the caller's function; anything else ends the run.
            backend = "tfidf (embedder failed)"
    return cut(semantic_clusters(candidates)), backend


def with_semantics(
    logs: DataFrame,
    encode: Callable[[list[str]], object] | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, str]:
    """Add semantic_cluster; an embedder that fails falls back to TF-IDF."""
    column = "event_template" if "event_template" in logs.columns else "clean_log"
    named = logs.withColumn("event_template", F.col(column))
    clusters, backend = semantic_labels(cut(semantic_candidates(named, limit)), encode)
    mapped = map_semantic(named, clusters)
    return (mapped if column == "event_template" else mapped.drop("event_template")), backend


def _keyed(kinds: DataFrame) -> DataFrame:
    """Groups with a stand-in for a line id, which the lookups use to deal out rows."""
    return kinds.withColumn("line_id", F.xxhash64("event_template", "level", "message_length"))


def run(
    spark: SparkSession,
    path: str,
    log_source: str | None = None,
    incidents_path: str | None = None,
    raw_path: str | None = None,
    contamination: float = fixed.CONTAMINATION,
    method: str = "dbscan",
    eps: float = fixed.DBSCAN_EPS,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
    n_clusters: int = 5,
    encode: Callable[[list[str]], object] | None = None,
) -> RunResult:
    """Diagnose one log: a file, or a directory holding the parts of one log."""
    name = log_source or path.rstrip("/").rsplit("/", 1)[-1]
    profile = profile_logs(read_for_profile(spark, path, log_name=name))
    lines = cut(
        scan_lines(spark, path, as_one_log=True)
        .withColumn("log_source", F.lit(name))
        .select("log_source", "line_id", "raw_log")
    )
    result = run_on(lines, name, incidents_path, raw_path, contamination, method, eps,
                    min_samples, n_clusters, encode)
    result.profile = profile
    if raw_path:
        append_raw_logs(profile_record(profile, now_text()), raw_path)
    return result


def now_text():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def run_on(
    lines: DataFrame,
    log_source: str,
    incidents_path: str | None = None,
    raw_path: str | None = None,
    contamination: float = fixed.CONTAMINATION,
    method: str = "dbscan",
    eps: float = fixed.DBSCAN_EPS,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
    n_clusters: int = 5,
    encode: Callable[[list[str]], object] | None = None,
) -> RunResult:
    """Diagnose lines given with log_source, line_id (unique) and raw_log."""
    run_id = f"run_{uuid.uuid4().hex[:8]}"
    if lines.isEmpty():
        raise ValueError("the log is empty or has no valid lines")
    parsed = cut(row_features(parse(lines)))
    vectors, vocabulary = template_vectors(parsed)
    width = vocabulary.count()

    # All that is found out is the same for rows of one template, level and length. One table
    # of these groups collects it and meets the rows once.
    template = F.coalesce(F.col("event_template"), F.lit(""))
    frequency = vectors.select(F.col("text").alias("_text"), F.col("m").cast("double").alias("template_frequency"))
    kinds = parsed.groupBy("event_template", "level", "severity", "message_length").agg(F.count(F.lit(1)).alias("m"))
    kinds = cut(kinds.join(frequency, template == F.col("_text")).drop("_text"))
    groups = cut(kinds.groupBy(*_GROUP).agg(F.sum("m").alias("m")))
    told = {"_text": template}
    rows = lookup(parsed.select("log_source", "line_id", "event_template", "severity", "message_length"), frequency, told)
    verdicts = group_verdicts(rows, groups, vectors, width, contamination)
    labels, backend = statistical_clusters(vectors, width, method, eps, min_samples, n_clusters)
    labels = cut(labels)
    points = vectors.join(labels, "vec_id").select("vec_id", "vec", "m", "label")
    shape = silhouette(points).first()[0]
    spread = davies_bouldin(points).first()[0]
    texts = vectors.select("text", "m", F.col("vec_id").alias("first_line"))
    clusters, semantic_backend = semantic_labels(texts, encode)

    found = _on_group(kinds, verdicts).select(
        kinds["event_template"], kinds["level"], kinds["message_length"], verdicts["is_anomaly"], verdicts["anomaly_score"]
    )
    found = cut(map_semantic(attach_statistical_label(_keyed(found), vectors, labels), clusters))
    # An embedder that failed on the templates is not tried again.
    found = generate_alerts(found, encode=encode if semantic_backend == "embedder" else None).drop("line_id")
    by = {c: F.col(c) for c in ("event_template", "level", "message_length")}
    plain = parsed.drop("severity")
    diagnosed = cut(lookup(plain, found, by).drop("message_length"))

    saved, error = 0, None
    if incidents_path:
        try:
            saved = save_incidents(diagnosed, incidents_path, log_source, run_id)
        except AnalysisException as failure:
            # A path or table that can't be written to; a lost job ends the run.
            error = str(failure)
    if raw_path:
        # The lines of this run, under the source name that its incidents have.
        records = with_header(lines, now_text()).withColumn("source", F.lit(log_source))
        replace_sources(records.select("source", "line_id", "timestamp", "level", "message"), raw_path)
    return RunResult(
        logs=diagnosed,
        run_id=run_id,
        log_source=log_source,
        profile=None,
        saved_incidents=saved,
        statistical_backend=backend,
        semantic_backend=semantic_backend,
        silhouette_score=round(float(shape or 0.0), 4),
        davies_bouldin_index=round(float(spread or 0.0), 4),
        persistence_error=error,
    )
