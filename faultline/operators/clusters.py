"""Clustering by a named method, the same at every size, and mapping of cluster labels back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline import fixed
from faultline.functions.text import embeddable
from faultline.operators.centroids import kmeans, reduced_kmeans
from faultline.operators.density import dbscan, dbscan_dense
from faultline.operators.lookup import lookup
from faultline.operators.features import VECTOR, fit_vocabulary, vectorize
from faultline.session import cut


def statistical_clusters(
    vectors: DataFrame,
    width: int,
    method: str = "dbscan",
    eps: float = fixed.DBSCAN_EPS,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
    n_clusters: int = 5,
) -> tuple[DataFrame, str]:
    """(vec_id, label) and the method used.

    ``vectors`` holds distinct vectors with vec_id, vec and m. The method is
    "dbscan", or "kmeans" on reduced vectors; the number of rows never changes it.
    """
    rows = vectors.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    if rows <= 1:
        return vectors.select("vec_id", F.lit(0).alias("label")), "single"
    if method not in ("dbscan", "kmeans", "minibatch_kmeans"):
        raise ValueError(f"unknown method {method}")
    if method != "dbscan":
        # One implementation: minibatches are a single-machine shortcut.
        return reduced_kmeans(vectors, width, rows, n_clusters), "kmeans"
    return dbscan(vectors, eps, min_samples), "dbscan"


def attach_statistical_label(
    logs: DataFrame, vectors: DataFrame, labels: DataFrame
) -> DataFrame:
    """Put the label of its template on every row, as ``dbscan_cluster``."""
    by_text = vectors.join(labels, "vec_id").select("text", F.col("label").alias("dbscan_cluster"))
    key: Column = F.coalesce(F.col("event_template"), F.lit(""))
    return lookup(logs.drop("dbscan_cluster"), by_text, {"text": key})


def _numbered(texts: DataFrame) -> DataFrame:
    """``vec_id`` in the order of frequency; only its order matters, not its gaps."""
    ordered = texts.orderBy(F.desc("m"), "first_line", "text")
    return cut(ordered.withColumn("vec_id", F.monotonically_increasing_id()))


def semantic_clusters(
    texts: DataFrame,
    eps: float = fixed.SEMANTIC_EPS,
    min_samples: int = fixed.SEMANTIC_MIN_SAMPLES,
    method: str = "dbscan",
    n_clusters: int = fixed.LARGE_LOG_CLUSTERS,
) -> DataFrame:
    """(text, label) for distinct texts given with text, m and first_line.

    Weights are fitted on the distinct texts, each counting once.
    """
    numbered = _numbered(texts)
    once = numbered.select(
        "vec_id", F.col("text").alias("original"), embeddable(F.col("text")).alias("text"), F.lit(1).alias("m")
    )
    corpus = once.groupBy("text").agg(F.sum("m").alias("m"))
    vocabulary = cut(fit_vocabulary(corpus, fixed.TFIDF_SEMANTIC_TERMS))
    vectors = cut(vectorize(once, vocabulary))
    rows, width = vectors.count(), vocabulary.count()
    if rows <= 1:
        labels = vectors.select("vec_id", F.lit(0).alias("label"))
    elif method == "kmeans":
        labels = reduced_kmeans(vectors, width, rows, n_clusters)
    else:
        labels = dbscan(vectors, eps, min_samples)
    return once.join(labels, "vec_id").select(F.col("original").alias("text"), "label")


def semantic_clusters_dense(
    embedded: DataFrame,
    eps: float = fixed.SEMANTIC_EPS,
    min_samples: int = fixed.SEMANTIC_MIN_SAMPLES,
    method: str = "dbscan",
    n_clusters: int = fixed.LARGE_LOG_CLUSTERS,
) -> DataFrame:
    """(vec_id, label) of dense embeddings given with vec_id and embedding."""
    rows = embedded.count()
    if rows <= 1:
        return embedded.select("vec_id", F.lit(0).alias("label"))
    values = F.transform("embedding", lambda x: x.cast("double"))
    if method == "kmeans":
        points = embedded.select("vec_id", F.lit(1).alias("m"), values.alias("reduced"))
        return kmeans(points, "reduced", n_clusters)
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    if eps < 1:
        kind = embedded.schema["embedding"].dataType.elementType.typeName()
        numbers = F.col("embedding") if kind in ("float", "double") else values
        return dbscan_dense(embedded.select("vec_id", numbers.alias("embedding"), norm.alias("norm")), eps, min_samples)
    entries = F.transform(
        values, lambda x, k: F.struct(k.alias("i"), (x / F.col("norm")).alias("w"))
    )
    vectors = embedded.select("vec_id", "embedding", norm.alias("norm")).select(
        "vec_id",
        F.when(F.col("norm") > 0, entries).otherwise(F.array().cast(VECTOR)).alias("vec"),
        F.lit(1).alias("m"),
    )
    return dbscan(vectors, eps, min_samples)
