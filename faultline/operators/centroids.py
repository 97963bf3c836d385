"""Truncated SVD and KMeans on weighted distinct vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from faultline import fixed


def _dense(entries: pa.ListArray, width: int) -> np.ndarray:
    """Lists of (i, w) as the rows of a matrix."""
    out = np.zeros((len(entries), width))
    rows = np.repeat(np.arange(len(entries)), entries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = entries.flatten()
    out[rows, flat.field("i").to_numpy(zero_copy_only=False)] = flat.field("w").to_numpy(zero_copy_only=False)
    return out


def gram_matrix(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of m * x x^T over all rows; every task adds up its own rows first."""

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _dense(batch.column("vec"), width)
            m = batch.column("m").to_numpy(zero_copy_only=False).astype(float)
            total += (x * m[:, None]).T @ x
        rows = pa.array(range(width), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [rows, pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "line"]
        )

    added = [F.sum(F.col("line")[k]).alias(f"c{k}") for k in range(width)]
    lines = (
        vectors.select("vec", "m")
        .mapInArrow(partial, "i int, line array<double>")
        .groupBy("i")
        .agg(F.array(*added).alias("line"))
    )
    # width x width numbers, whatever the number of rows.
    matrix = np.zeros((width, width))
    for row in lines.collect():
        matrix[row.i] = row.line
    return matrix


def svd_basis(vectors: DataFrame, width: int, components: int) -> np.ndarray:
    """Right singular vectors (width x components), strongest first, no centring."""
    values, basis = np.linalg.eigh(gram_matrix(vectors, width))
    basis = basis[:, np.argsort(values)[::-1][:components]]
    # A fixed sign: the largest entry of each direction is positive.
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])])
    return basis * np.where(signs == 0, 1.0, signs)


def component_count(width: int, rows: int) -> int:
    return max(2, min(fixed.SVD_COMPONENTS, width - 1, rows - 1))


def svd_project(vectors: DataFrame, basis: np.ndarray) -> DataFrame:
    """Add ``reduced``: the vector in the basis, as a dense array."""
    width = basis.shape[0]

    def project(batches):
        for batch in batches:
            reduced = _dense(batch.column("vec"), width) @ basis
            yield batch.append_column("reduced", pa.array(reduced.tolist(), pa.list_(pa.float64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(project, f"{fields}, reduced array<double>")


def kmeans(rows: DataFrame, column: str, k: int, seed: int = fixed.SEED) -> DataFrame:
    """(vec_id, label) of a weighted KMeans; labels follow the smallest vec_id.

    ``rows`` has vec_id, m and an array column. The weight makes a distinct vector
    count as often as it occurs, so the duplicates never reach the iterations.
    """
    points = rows.select("vec_id", F.col("m").cast("double").alias("m"), array_to_vector(F.col(column)).alias("features"))
    points = points.persist()
    try:
        model = KMeans(k=k, seed=seed, weightCol="m").fit(points)
    finally:
        points.unpersist()
    raw = model.transform(points).select("vec_id", F.col("prediction").alias("raw"))
    # At most k rows.
    firsts = raw.groupBy("raw").agg(F.min("vec_id").alias("first")).orderBy("first").collect()
    number = F.create_map(*[F.lit(x) for place, row in enumerate(firsts) for x in (row.raw, place)])
    return raw.select("vec_id", number[F.col("raw")].cast("int").alias("label"))


def reduced_kmeans(vectors: DataFrame, width: int, rows: int, clusters: int) -> DataFrame:
    """KMeans on the SVD-reduced sparse vectors."""
    basis = svd_basis(vectors, width, component_count(width, rows))
    return kmeans(svd_project(vectors, basis), "reduced", max(2, min(clusters, rows - 1)))
