"""Isolation Forest (Liu, Ting, Zhou 2008) over weighted distinct feature rows.

The rows behind the trees are a sample of fixed size by definition (trees x
subsample), picked by a hash of the row key, so the fit does not depend on the
partitioning. The model is a few thousand nodes and is broadcast; scoring is a
map-only pass over the distinct feature rows. The anomaly cut is an exact
percentile, found from counts per score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline import fixed
from faultline.session import cut

_TREE = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, "
    "right array<int>, depth array<double>"
)


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}
    waiting = [(np.arange(len(x)), 0, -1, "")]
    while waiting:
        members, depth, parent, side = waiting.pop()
        here = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = here
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        leaf = depth >= limit or len(members) <= 1 or not len(splittable)
        feature = -1 if leaf else int(rng.choice(splittable))
        cut = 0.0 if leaf else float(rng.uniform(low[feature], high[feature]))
        nodes["feature"].append(feature)
        nodes["threshold"].append(cut)
        nodes["left"].append(-1)
        nodes["right"].append(-1)
        nodes["depth"].append(depth + _path_length(len(members)))
        if not leaf:
            goes_left = part[:, feature] <= cut
            waiting.append((members[~goes_left], depth + 1, here, "right"))
            waiting.append((members[goes_left], depth + 1, here, "left"))
    return nodes


def _matrix(vec: list, numeric: list, width: int) -> np.ndarray:
    out = np.zeros((len(vec), width + len(numeric[0]) if numeric else width))
    for row, (pairs, extra) in enumerate(zip(vec, numeric)):
        for pair in pairs:
            out[row, pair["i"]] = pair["w"]
        out[row, width:] = extra
    return out


def sample_rows(rows: DataFrame, keys: list[str], size: int, seed: int) -> DataFrame:
    """A fixed-size sample: the rows with the smallest hash of seed and key.

    Only about twice the wanted rows pass the first cut by hash, so the final
    top-k does not gather ``size`` rows from every task.
    """
    total = rows.count()
    order = F.xxhash64(F.lit(seed), *keys)
    hashed = rows.withColumn("_order", F.shiftrightunsigned(order, 11))
    share = 2.0 * size / max(total, 1)
    while True:
        near = hashed
        if share < 1.0:
            near = hashed.where(F.col("_order") < int(share * (1 << 53)))
        sample = cut(near.orderBy("_order", *keys).limit(size).drop("_order"))
        if share >= 1.0 or sample.count() == size:
            return sample
        share *= 2


def fit_forest(
    sample: DataFrame,
    keys: list[str],
    width: int,
    trees: int = fixed.FOREST_TREES,
    subsample: int = fixed.FOREST_SUBSAMPLE,
    seed: int = fixed.SEED,
) -> list:
    """Grow the trees, one task group each; returns the node lists of all trees.

    ``sample`` has vec (sparse), numeric (array) and the key columns, and at most
    trees x subsample rows; every tree draws its own rows from it, without
    replacement and seeded by its number.
    """
    # A window over the sample, whose size is fixed.
    place = F.row_number().over(W.partitionBy().orderBy(F.xxhash64(F.lit(seed), *keys), *keys))
    pool = sample.withColumn("place", place).persist()
    try:
        n = pool.count()
        per_tree = min(subsample, n)
        limit = int(np.ceil(np.log2(max(per_tree, 2))))

        def draw(batches):
            for pdf in batches:
                for tree in pdf["id"]:
                    chosen = np.random.default_rng([seed, 0, tree]).choice(n, per_tree, replace=False)
                    yield pd.DataFrame({"tree": int(tree), "place": chosen + 1})

        spark = sample.sparkSession
        draws = spark.range(trees).mapInPandas(draw, "tree int, place int")
        picked = draws.join(pool.select("place", "vec", "numeric"), "place")
        return _grow_all(picked, seed, width, limit)
    finally:
        pool.unpersist()


def _grow_all(picked: DataFrame, seed: int, width: int, limit: int) -> list:
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        tree = int(pdf["tree"].iloc[0])
        x = _matrix(list(pdf["vec"]), list(pdf["numeric"]), width)
        nodes = _grow(x, np.random.default_rng([seed, 1, tree]), limit)
        return pd.DataFrame([{"tree": tree, **nodes}])

    # trees x at most 2 * subsample nodes, whatever the data.
    return sorted(picked.groupBy("tree").applyInPandas(grow, _TREE).collect(), key=lambda r: r.tree)


def score_forest(rows: DataFrame, model: list, width: int, subsample: int) -> DataFrame:
    """Add ``outlierness`` = 2^(-mean depth / c): near 1 for outliers."""
    shared = rows.sparkSession.sparkContext.broadcast(
        [
            tuple(np.asarray(part) for part in (t.feature, t.threshold, t.left, t.right, t.depth))
            for t in model
        ]
    )
    scale = max(_path_length(subsample), 1e-12)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec").to_pylist(), batch.column("numeric").to_pylist(), width)
            every = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, threshold, left, right, depth in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    split = feature[at]
                    inner = split >= 0
                    if not inner.any():
                        break
                    goes_left = x[every, np.where(inner, split, 0)] <= threshold[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                total += depth[at]
            value = np.exp2(-(total / len(shared.value)) / scale)
            yield batch.append_column("outlierness", pa.array(np.round(value, 12)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(score, f"{fields}, outlierness double")


def exact_percentile(rows: DataFrame, value: str, weight: str, share: float, bins: int = 2048) -> float:
    """Linear-interpolated percentile of weighted values, without a global sort.

    The range is narrowed by histograms of ``bins`` counts until the wanted ranks
    are held by a short list of distinct values.
    """
    first = rows.agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.sum(weight).alias("n")
    ).first()
    target = share * (first["n"] - 1)
    ranks = [int(np.floor(target)), int(np.ceil(target))]

    def at_rank(rank: int) -> float:
        low, high, below = first["low"], first["high"], 0
        inside = rows
        while True:
            if low == high:
                return low
            step = (high - low) / bins
            place = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / step).cast("int"))
            counts = (
                inside.groupBy(place.alias("bin"))
                .agg(F.sum(weight).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
                .orderBy("bin")
                .collect()
            )
            for row in counts:
                if rank < below + row["n"]:
                    low, high = row["low"], row["high"]
                    break
                below += row["n"]
            inside = rows.where(F.col(value).between(low, high))

    lower = at_rank(ranks[0])
    upper = lower if ranks[1] == ranks[0] else at_rank(ranks[1])
    return float(lower + (upper - lower) * (target - ranks[0]))


def detect(scored: DataFrame, weight: str, contamination: float = fixed.CONTAMINATION) -> DataFrame:
    """Add ``is_anomaly`` and the four-decimal ``anomaly_score``."""
    normality = scored.withColumn("_normality", -F.col("outlierness"))
    cut = exact_percentile(normality, "_normality", weight, contamination)
    decision: Column = F.col("_normality") - F.lit(cut)
    return (
        normality.withColumn("is_anomaly", decision < 0)
        .withColumn("anomaly_score", F.bround(-decision, 4))
        .drop("_normality", "outlierness")
    )
