"""DBSCAN with cosine distance, on distinct vectors with a multiplicity.

Equal vectors are at distance 0, so they share their fate: a vector is a core
point if the multiplicities of its eps-neighbourhood add up to ``min_samples``.
Neighbourhoods come from the block search, which reports counts and a spanning
forest per block instead of pairs. Clusters are the connected components of the
core points, numbered by their first line, as a scan in line order would.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline import fixed
from faultline.operators.neighbours import (
    BLOCK_ROWS,
    DENSE_ROWS,
    block_sides,
    compare_blocks,
    compare_dense,
    dense_points,
)
from faultline.operators.trend import with_position
from faultline.session import cut


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vec_id, root) with the smallest vec_id of each component as its root.

    Every round hooks each root to the smallest root next to its members and then
    halves the paths, so the number of rounds grows with the logarithm of the
    longest path. Each round is cut by a checkpoint.
    """
    both = cut(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = vertices.select("vec_id", F.col("vec_id").alias("root"))
    if both.isEmpty():
        return labels
    labels = cut(labels)
    while True:
        beside = (
            both.join(labels.select(F.col("vec_id").alias("b"), F.col("root").alias("rb")), "b")
            .groupBy(F.col("a").alias("vec_id"))
            .agg(F.min("rb").alias("near"))
        )
        lowered = labels.join(beside, "vec_id", "left").select(
            "vec_id", "root", F.least("root", "near").alias("low")
        )
        # A root learns the smallest neighbour of all of its members.
        hooks = lowered.groupBy(F.col("root").alias("old")).agg(F.min("low").alias("hook"))
        hooked = lowered.join(hooks, F.col("root") == F.col("old")).select(
            "vec_id", "root", F.least("low", "hook").alias("next")
        )
        jump = hooked.select(F.col("vec_id").alias("next"), F.col("next").alias("next2"))
        moved = cut(
            hooked.join(jump, "next").select(
                "vec_id",
                F.least("next", "next2").alias("root"),
                (F.least("next", "next2") != F.col("root")).alias("changed"),
            )
        )
        labels = moved.select("vec_id", "root")
        if moved.where("changed").isEmpty():
            return labels


class _Forest:
    """A spanning forest of neighbour pairs, which come a strip of rows at a time."""

    def __init__(self, nodes: np.ndarray):
        self.ids, self.place = np.unique(nodes, return_inverse=True)
        self.root = np.arange(len(self.ids))
        self.kept: list[tuple[int, int]] = []

    def add(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        """Neighbours by the positions of their rows among the ``nodes``."""
        right = self.place[right]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            mine, others = self.place[left[i]], right[near[i]]
            roots = self.root[others]
            if (roots == self.root[mine]).all():
                continue
            found, first = np.unique(roots, return_index=True)
            for root, at in zip(found.tolist(), first.tolist()):
                if root != self.root[mine]:
                    self.kept.append((int(self.ids[mine]), int(self.ids[others[at]])))
            found = np.append(found, self.root[mine])
            self.root[np.isin(self.root, found)] = found.min()


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the neighbour pairs of one pair of blocks."""
    forest = _Forest(np.concatenate([left, right]))
    forest.add(np.arange(len(left)), np.arange(len(left), len(left) + len(right)), near)
    return forest.kept


class _Counts:
    """How many rows, by their ``m``, are near each row of a task."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.weight = rows["vec_id"].to_numpy(), rows["m"].to_numpy()
        self.found = np.zeros(len(rows), np.int64)

    def add(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        self.found[left] += near @ self.weight[right]
        self.found[right] += self.weight[left] @ near

    def rows(self) -> pd.DataFrame:
        keep = self.found > 0
        return pd.DataFrame({"vec_id": self.ids[keep], "found": self.found[keep]})


class _Links:
    """A forest of the core rows of a task by their ``root``, and the border rows next to a core row."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.core = rows["vec_id"].to_numpy(), rows["core"].to_numpy(dtype=bool)
        self.forest, self.border = _Forest(rows["root"].to_numpy()), []

    def add(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        core_a, core_b = self.core[left], self.core[right]
        if core_a.all() and core_b.all():
            self.forest.add(left, right, near)
            return
        self.forest.add(left, right, near & core_a[:, None] & core_b[None, :])
        # A border point has fewer than min_samples neighbours, so these stay few.
        for i, j in zip(*np.nonzero(near & (core_a[:, None] != core_b[None, :]))):
            a, b = (left[i], right[j]) if core_a[i] else (right[j], left[i])
            self.border.append((int(self.ids[a]), int(self.ids[b])))

    def rows(self) -> pd.DataFrame:
        rows = [(a, b, True) for a, b in self.forest.kept] + [(a, b, False) for a, b in self.border]
        a, b, both = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "both": np.array(both, bool)})


def _only_partly_close(vectors: DataFrame) -> bool:
    """Some weights are negative, and no vector is empty (one would be at distance 1 from all)."""
    empty, negative = vectors.agg(
        F.count_if(F.size("vec") == 0), F.count_if(F.exists("vec", lambda x: x["w"] < 0))
    ).first()
    return empty == 0 and negative > 0


def _lifted(vectors: DataFrame) -> DataFrame:
    """Unit vectors with one more, common weight, which turn a distance d into d / 3."""
    common = F.array(F.struct(F.lit(1 << 30).alias("i"), F.lit((2 / 3) ** 0.5).alias("w")))
    scaled = F.transform("vec", lambda x: F.struct(x["i"].alias("i"), (x["w"] * 3**-0.5).alias("w")))
    return vectors.withColumn("vec", F.concat(scaled, common))


def dbscan(
    vectors: DataFrame,
    eps: float = fixed.DBSCAN_EPS,
    min_samples: int = fixed.DBSCAN_MIN_SAMPLES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, label), -1 for noise.

    ``vectors`` has vec_id (the first line of the vector), vec and m, the number
    of rows behind it. Vectors without terms are at distance 1 from everything
    else: noise, or clusters of their own when ``min_samples`` is 1, in which case
    each row must come with its own vec_id. A single row is labelled 0.
    """
    size = vectors.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()["n"]
    if size <= 1:
        return vectors.select("vec_id", F.lit(0).alias("label"))
    if 1 <= eps < 2 and _only_partly_close(vectors):
        return dbscan(_lifted(vectors), eps / 3, min_samples, block_rows)
    if eps >= 1:
        # Without negative weights no distance exceeds 1; with them none exceeds 2.
        label = 0 if size >= min_samples else -1
        return vectors.select("vec_id", F.lit(label).alias("label"))

    filled = cut(vectors.where(F.size("vec") > 0).select("vec_id", "vec", F.col("m").cast("long").alias("m")))
    empty = vectors.where(F.size("vec") == 0).select("vec_id")

    sides = cut(block_sides(filled, eps, ["m"], block_rows))

    if min_samples <= 1:
        points = filled.select("vec_id", F.lit(True).alias("core"))
    else:

        def count(a, b, close, near):
            weight_a, weight_b = a["m"].to_numpy(), b["m"].to_numpy()
            ids = np.concatenate([a["vec_id"].to_numpy(), b["vec_id"].to_numpy()])
            found = np.concatenate([near @ weight_b, weight_a @ near])
            keep = found > 0
            return pd.DataFrame({"vec_id": ids[keep], "found": found[keep]})

        counts = (
            compare_blocks(sides, eps, count, "vec_id long, found long")
            .groupBy("vec_id")
            .agg(F.sum("found").alias("found"))
        )
        around = F.col("m") + F.coalesce(F.col("found"), F.lit(0))
        points = cut(
            filled.join(counts, "vec_id", "left").select(
                "vec_id", (around >= min_samples).alias("core")
            )
        )

    def link(a, b, close, near):
        core_a, core_b = a["core"].to_numpy(), b["core"].to_numpy()
        left, right = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        rows = [
            (x, y, True) for x, y in _forest(near & core_a[:, None] & core_b[None, :], left, right)
        ]
        # A border point has fewer than min_samples neighbours, so these stay few.
        for i, j in zip(*np.nonzero(near & (core_a[:, None] != core_b[None, :]))):
            pair = (left[i], right[j]) if core_a[i] else (right[j], left[i])
            rows.append((int(pair[0]), int(pair[1]), False))
        return pd.DataFrame(rows, columns=["a", "b", "both"])

    flagged = sides.join(points, "vec_id")
    links = cut(compare_blocks(flagged, eps, link, "a long, b long, both boolean"))
    return _labels(vectors, points, empty, links, min_samples)


def dbscan_dense(
    vectors: DataFrame, eps: float, min_samples: int, block_rows: int = DENSE_ROWS
) -> DataFrame:
    """(vec_id, label), -1 for noise, as ``dbscan`` gives with an ``eps`` below 1, a weight of 1 a row.

    ``vectors`` has vec_id, embedding (numbers) and norm; rows without a norm above 0 are at distance 1
    from everything else. Blocks of vectors are compared within, then across, where what
    the first pass joined is one node: a large cluster gives few links.
    """
    some = F.col("norm") > 0
    long = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "norm", F.lit(1).cast("long").alias("m"))
    points = cut(dense_points(long.where(some), ["m"], block_rows))
    empty = vectors.where(~F.coalesce(some, F.lit(False))).select("vec_id")
    if min_samples <= 1:
        cores = cut(points.select("vec_id", F.lit(True).alias("core")))
    else:
        counts = compare_dense(points, eps, _Counts, "vec_id long, found long", inside=True, across=True)
        counts = counts.groupBy("vec_id").agg(F.sum("found").alias("found"))
        around = F.col("m") + F.coalesce(F.col("found"), F.lit(0))
        cores = cut(
            points.select("vec_id", "m").join(counts, "vec_id", "left").select(
                "vec_id", (around >= min_samples).alias("core")
            )
        )
    core = cores.groupBy("vec_id").agg(F.max("core").alias("core"))
    schema = "a long, b long, both boolean"
    alone = points.join(core, "vec_id").withColumn("root", F.col("vec_id"))
    first = cut(compare_dense(alone, eps, _Links, schema, inside=True, across=False))
    ids = core.where("core").select("vec_id")
    joined = connected_components(ids, first.where("both"))
    joined = points.join(core, "vec_id").join(joined, "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id"))
    second = cut(compare_dense(joined, eps, _Links, schema, inside=False, across=True))
    return _labels(vectors, cores, empty, first.unionByName(second), min_samples)


def _labels(vectors: DataFrame, points: DataFrame, empty: DataFrame, links: DataFrame, min_samples: int) -> DataFrame:
    """(vec_id, label): components of the core points by their first line, border points with the least label beside them."""
    core = points.where("core").select("vec_id")
    if min_samples <= 1:
        core = core.union(empty)
    roots = connected_components(core, links.where("both"))
    first_lines = roots.where(F.col("vec_id") == F.col("root")).select(
        F.col("root").alias("line_id"), F.lit(1).alias("one")
    )
    numbers = with_position(first_lines, [], "one").select(
        F.col("line_id").alias("root"), (F.col("pos") - 1).cast("int").alias("label")
    )
    labelled = roots.join(numbers, "root").select("vec_id", "label")
    border = (
        links.where(~F.col("both"))
        .join(labelled.withColumnRenamed("vec_id", "a"), "a")
        .groupBy(F.col("b").alias("vec_id"))
        .agg(F.min("label").alias("label"))
    )
    return (
        vectors.select("vec_id")
        .join(labelled.union(border), "vec_id", "left")
        .select("vec_id", F.coalesce(F.col("label"), F.lit(-1)).cast("int").alias("label"))
    )
