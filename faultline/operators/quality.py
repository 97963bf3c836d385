"""Cluster quality from per-cluster sums, linear in the number of distinct vectors.

``points`` has vec_id, vec (unit length or empty), m (rows behind the vector) and
label. The same vector may appear under several labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LABEL_BLOCK = 512
POINT_PART = 4_096


def _long(points: DataFrame) -> DataFrame:
    return points.select("vec_id", "label", "m", F.explode("vec").alias("x")).select(
        "vec_id", "label", "m", F.col("x.i").alias("i"), F.col("x.w").alias("w")
    )


def _defined(points: DataFrame) -> bool:
    """Both measures need more than one cluster and fewer clusters than rows."""
    row = points.groupBy("label").agg(F.sum("m").alias("n")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")
    ).first()
    return row["n"] is not None and 1 < row["k"] < row["n"]


def _matrix(places: list, weights: list, columns: np.ndarray) -> np.ndarray:
    """Rows of sparse entries as a dense matrix over the sorted ``columns``."""
    out = np.zeros((len(places), len(columns)))
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    if len(rows):
        out[rows, np.searchsorted(columns, np.concatenate(places))] = np.concatenate(weights)
    return out


def _nearest_other(key: tuple, points: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """For each point the least distance to the other clusters of a block, and its product with its own."""
    none = np.zeros(0)
    sides = [
        [[none if e is None else np.asarray(e) for e in side[c]] for c in ("i", "w")] for side in (points, sums)
    ]
    columns = np.unique(np.concatenate([e for side in sides for e in side[0]] + [none]))
    dots = _matrix(*sides[0], columns) @ _matrix(*sides[1], columns).T
    own = points["own"].to_numpy()[:, None] == sums["label"].to_numpy()[None, :]
    distance = np.where(own, np.inf, 1.0 - dots / sums["size"].to_numpy()[None, :])
    return pd.DataFrame(
        {
            "vec_id": points["vec_id"],
            "own": points["own"],
            "closest": distance.min(axis=1, initial=np.inf),
            "own_dot": np.where(own, dots, -np.inf).max(axis=1, initial=-np.inf),
        }
    )


def silhouette(points: DataFrame, block: int = LABEL_BLOCK, part: int = POINT_PART) -> DataFrame:
    """Mean cosine silhouette over all rows (noise counts as a label), one row.

    The mean distance of x to a cluster is 1 - x . (sum of the cluster) / size; in
    its own cluster x itself is taken out. Vectors without terms are at distance 1
    from everything but themselves. Parts of the points are multiplied with blocks of
    the sums; a part gives one row for each point and block. 0 where it is not defined.
    """
    if not _defined(points):
        return points.sparkSession.range(1).select(F.lit(0.0).alias("silhouette"))
    sizes = points.groupBy("label").agg(F.sum("m").alias("size"))
    sums = _long(points).groupBy("label", "i").agg(F.sum(F.col("w") * F.col("m")).alias("s"))
    sums = sums.groupBy("label").agg(F.collect_list(F.struct("i", "s")).alias("sums"))
    rows = points.select("vec_id", F.col("label").alias("own"), "m", "vec").join(
        sizes.select(F.col("label").alias("own"), "size"), "own"
    )
    parts = F.lit(-(-points.count() // part))
    blocks = F.lit(-(-sizes.count() // block))

    left = points.select(
        "vec_id", F.col("label").alias("own"), F.col("vec.i").alias("i"), F.col("vec.w").alias("w"),
        F.pmod(F.xxhash64("vec_id", "label"), parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )
    right = sizes.join(sums, "label", "left").select(
        "label", "size", F.col("sums.i").alias("i"), F.col("sums.s").alias("w"),
        F.pmod(F.xxhash64("label"), blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
    )
    kinds = dict(points.dtypes)
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(
        _nearest_other, f"vec_id {kinds['vec_id']}, own {kinds['label']}, closest double, own_dot double"
    )
    reached = found.groupBy("vec_id", "own").agg(F.min("closest").alias("closest"), F.max("own_dot").alias("own_dot"))
    # x . x is 1 for a unit vector and the self distance of an empty one is 0.
    inside = F.col("size") - F.col("own_dot")
    a = (inside - F.when(F.size("vec") > 0, 0.0).otherwise(1.0)) / F.nullif(F.col("size") - 1, F.lit(0))
    b = F.col("closest")
    top = F.greatest(a, b)
    value = F.when(F.col("size") == 1, 0.0).when(top > 0, (b - a) / top).otherwise(0.0)
    return rows.join(reached, ["vec_id", "own"]).agg((F.sum(value * F.col("m")) / F.sum("m")).alias("silhouette"))


def davies_bouldin(points: DataFrame, block: int = LABEL_BLOCK) -> DataFrame:
    """Davies-Bouldin index with Euclidean distance, one row."""
    if not _defined(points):
        return points.sparkSession.range(1).select(F.lit(0.0).alias("davies_bouldin"))
    long = _long(points)
    sizes = points.groupBy("label").agg(F.sum("m").alias("size"))
    centres = (
        long.groupBy("label", "i")
        .agg(F.sum(F.col("w") * F.col("m")).alias("s"))
        .join(sizes, "label")
        .select("label", "i", (F.col("s") / F.col("size")).alias("c"))
    )
    norms = sizes.join(
        centres.groupBy("label").agg(F.sum(F.col("c") * F.col("c")).alias("cc")), "label", "left"
    ).select("label", "size", F.coalesce("cc", F.lit(0.0)).alias("cc"))
    dots = (
        long.join(centres, ["label", "i"])
        .groupBy("vec_id", "label")
        .agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    )
    xx = F.when(F.size("vec") > 0, 1.0).otherwise(0.0)
    distance = F.sqrt(
        F.greatest(F.lit(0.0), xx - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("cc"))
    )
    spread = (
        points.join(dots, ["vec_id", "label"], "left")
        .join(norms, "label")
        .groupBy("label")
        .agg((F.sum(distance * F.col("m")) / F.sum("m")).alias("spread"))
    )
    clusters = norms.join(spread, "label").join(
        centres.groupBy("label").agg(F.collect_list(F.struct("i", "c")).alias("centre")), "label", "left"
    )
    # Pairs of clusters are compared block by block; a task sees two blocks.
    blocks = clusters.agg(F.ceil(F.count(F.lit(1)) / block)).first()[0]
    sides = (
        clusters.withColumn("mine", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.greatest("mine", "other"))
    )

    def worst(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        lists = [c if c is not None else [] for c in pdf["centre"]]
        ids = sorted({e["i"] for c in lists for e in c})
        column = {i: k for k, i in enumerate(ids)}
        dense = np.zeros((len(pdf), len(ids)))
        for row, entries in enumerate(lists):
            for e in entries:
                dense[row, column[e["i"]]] = e["c"]
        mine = pdf["mine"].to_numpy()
        a, b = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        cc, spread = pdf["cc"].to_numpy(), pdf["spread"].to_numpy()
        label = pdf["label"].to_numpy()
        gap = np.sqrt(
            np.maximum(0.0, cc[a][:, None] + cc[b][None, :] - 2 * dense[a] @ dense[b].T)
        )
        near = spread[a][:, None] + spread[b][None, :]
        # Coinciding centres count as infinitely far apart.
        ratio = np.where(gap > 1e-12, near / np.where(gap > 1e-12, gap, 1.0), 0.0)
        ratio[label[a][:, None] == label[b][None, :]] = 0.0
        names = np.concatenate([label[a], label[b]])
        tops = [
            ratio.max(axis=1, initial=0.0),
            ratio.max(axis=0, initial=0.0),
        ]
        return pd.DataFrame({"label": names, "top": np.concatenate(tops)})

    kind = dict(points.dtypes)["label"]
    return (
        sides.groupBy("low", "high")
        .applyInPandas(worst, f"label {kind}, top double")
        .groupBy("label")
        .agg(F.max("top").alias("top"))
        .agg(F.avg("top").alias("davies_bouldin"))
    )
