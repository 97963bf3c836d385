"""Cosine neighbours within eps, without a distance matrix over all rows.

Vectors are distinct and unit-length. A pair can only be that similar if it
shares a term among the *leading* terms of either vector: terms are ordered from
rare to common, and the common tail of a vector is left out while its norm stays
below the wanted similarity (Bayardo et al. 2007, all-pairs search). Postings of
one leading term are cut into blocks; a task multiplies two blocks and reports
only what is asked for, never the candidate pairs. A pair sharing several leading
terms is handled under the rarest of them only.

Dense vectors share all terms, so every pair is compared, once: blocks of rows travel as
arrays of numbers and a task multiplies two of them a strip at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 1000
# Rows of a dense block, and numbers of it, whichever is less.
DENSE_ROWS = 16_384
DENSE_NUMBERS = 1 << 21
# Blocks that a small table is cut into all the same, to keep all tasks busy.
LEAST_BLOCKS = 12
_SLACK = 1e-9
_STRIP = 1 << 23


def _ranks(vectors: DataFrame) -> tuple[dict[int, int], int]:
    """Position of every term from rare to common, and the first one all vectors hold.

    Pairs sharing a universal term are handled under it or under a rarer one, so
    nothing after the first universal term needs to be looked at. The lists are as
    long as the vocabulary.
    """
    uses = (
        vectors.select(F.explode("vec").alias("x"))
        .groupBy(F.col("x.i").alias("i"))
        .agg(F.count(F.lit(1)).alias("uses"))
        .orderBy("uses", "i")
        .collect()
    )
    if not uses:
        # Vectors without terms only: the map must not be empty, and matches nothing.
        return {-1: 0}, 0
    total = vectors.count()
    ranks = {row.i: place for place, row in enumerate(uses)}
    universal = [ranks[row.i] for row in uses if row.uses == total]
    return ranks, min(universal, default=len(ranks))


def _literal_map(values: dict[int, int]):
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def _leading(vectors: DataFrame, ranks: dict[int, int], similarity: float) -> DataFrame:
    """Vectors re-indexed from rare to common, with the number of leading terms."""
    rank = _literal_map(ranks)
    terms = F.array_sort(
        F.transform("vec", lambda x: F.struct(rank[x["i"]].alias("r"), x["w"].alias("w")))
    )
    ranked = vectors.withColumn("terms", terms).drop("vec")
    # Squared norm of the tail that starts at each position, common terms last.
    bound = similarity * similarity - _SLACK
    tail = F.aggregate(
        F.reverse("terms"),
        F.struct(F.lit(0.0).alias("norm"), F.lit(0).alias("dropped")),
        lambda a, x: F.struct(
            (a["norm"] + x["w"] * x["w"]).alias("norm"),
            (a["dropped"] + (a["norm"] + x["w"] * x["w"] < bound).cast("int")).alias("dropped"),
        ),
    )
    return ranked.withColumn("lead", F.size("terms") - tail["dropped"])


def block_sides(
    vectors: DataFrame, eps: float, carry: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The two sides of every pair of blocks that may hold neighbours.

    ``vectors`` has vec_id (long, unique), vec (not empty) and the ``carry`` columns.
    """
    ranks, last = _ranks(vectors)
    leading = _leading(vectors.select("vec_id", "vec", *carry), ranks, 1.0 - eps)
    useful = F.filter(F.slice(F.col("terms.r"), F.lit(1), F.col("lead")), lambda r: r <= last)
    posted = leading.withColumn("term", F.explode(useful))
    sizes = posted.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    # A term of a single vector makes no pair; the literal map has no entry for it.
    counts = {row.term: -(-row.n // block_rows) for row in sizes if row.n > 1}
    blocks = _literal_map(counts or {-1: 1})[F.col("term")]
    return (
        posted.where(blocks.isNotNull())
        .withColumn("mine", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.greatest("mine", "other"))
    )


def compare_blocks(
    sides: DataFrame,
    eps: float,
    report: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run ``report`` on every pair of blocks.

    The callable gets both sides, the similarity matrix and a mask of the neighbour
    pairs to count (each unordered pair once over all tasks).
    """
    similarity = 1.0 - eps

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        term = int(pdf["term"].iloc[0])
        ids = sorted({t["r"] for row in pdf["terms"] for t in row})
        column = {r: k for k, r in enumerate(ids)}
        earlier = sum(r < term for r in ids)
        dense = np.zeros((len(pdf), len(ids)))
        lead = np.zeros((len(pdf), earlier), dtype=np.float32)
        for row, (entries, many) in enumerate(zip(pdf["terms"], pdf["lead"])):
            for place, entry in enumerate(entries):
                at = column[entry["r"]]
                dense[row, at] = entry["w"]
                if at < earlier and place < many:
                    lead[row, at] = 1.0
        left = np.flatnonzero(pdf["mine"].to_numpy() == low)
        right = np.flatnonzero(pdf["mine"].to_numpy() == high)
        close = np.einsum("ik,jk->ij", dense[left], dense[right], optimize=True)
        near = np.round(close, 9) >= similarity - 1e-12
        near &= (lead[left] @ lead[right].T) == 0
        if low == high:
            near &= np.triu(np.ones_like(near, dtype=bool), 1)
        return report(
            pdf.iloc[left].reset_index(drop=True), pdf.iloc[right].reset_index(drop=True), close, near
        )

    return sides.groupBy("term", "low", "high").applyInPandas(run, schema)


def cosine_neighbors(vectors: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All unordered pairs of vectors at cosine distance of at most ``eps`` (below 1)."""
    if eps >= 1:
        raise ValueError("at eps >= 1 every pair is a neighbour; nothing to search")

    def report(a, b, close, near):
        i, j = np.nonzero(near)
        left, right = a["vec_id"].to_numpy()[i], b["vec_id"].to_numpy()[j]
        return pd.DataFrame(
            {
                "id_a": np.minimum(left, right),
                "id_b": np.maximum(left, right),
                "similarity": close[i, j],
            }
        )

    schema = "id_a long, id_b long, similarity double"
    return compare_blocks(block_sides(vectors, eps, [], block_rows), eps, report, schema)


def dense_points(vectors: DataFrame, carry: list[str], block_rows: int = DENSE_ROWS) -> DataFrame:
    """vec_id, ``carry``, numbers (as many in every row), norm, and block of ``n_blocks``.

    ``vectors`` has vec_id (long), embedding (not null, float or double), norm (above 0) and the ``carry`` columns.
    """
    rows, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(-(-rows // max(1, min(block_rows, DENSE_NUMBERS // max(width, 1)))), min(LEAST_BLOCKS, -(-rows // BLOCK_ROWS)), 1)
    kind = vectors.schema["embedding"].dataType.elementType
    # A shorter vector has zeros where others have more.
    padding = F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size("embedding"))
    return vectors.select(
        "vec_id", *carry, F.concat("embedding", padding).alias("numbers"), "norm",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(blocks).alias("n_blocks"),
    )


def compare_dense(
    points: DataFrame, eps: float, report: Callable[[pd.DataFrame], object], schema: str, inside: bool, across: bool
) -> DataFrame:
    """Compare rows within blocks (``inside``), of different blocks (``across``), or both.

    ``report`` makes, from the rows of a task without their numbers, an object whose ``add(left, right, near)``
    gets the neighbour pairs of a strip of rows (positions of rows, and a matrix; each unordered
    pair once over all tasks) and whose ``rows()`` gives what the task returns.
    """
    similarity = 1.0 - eps
    # Numbers of half the length decide all but the pairs this near to the limit.
    unsure = 1e-4
    names = [c for c in points.columns if c not in ("numbers", "norm", "block", "n_blocks")]

    def run(table: pa.Table) -> pa.Table:
        flat = table.column("numbers").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit = flat.reshape(table.num_rows, -1).astype(np.float64)
        unit /= table.column("norm").to_numpy()[:, None]
        short = unit.astype(np.float32)
        mine, low, high = (table.column(c).to_numpy() for c in ("block", "low", "high"))
        left, right = np.flatnonzero(mine == low[0]), np.flatnonzero(mine == high[0])
        across = np.ascontiguousarray(short[right].T)
        found = report(table.select(names).to_pandas())
        step = max(1, _STRIP // max(len(right), 1))
        for start in range(0, len(left), step):
            strip = left[start : start + step]
            with np.errstate(all="ignore"):
                close = short[strip] @ across
            near = close >= similarity + unsure
            maybe = close >= similarity - unsure
            if np.count_nonzero(maybe) != np.count_nonzero(near):
                i, j = np.nonzero(maybe & ~near)
                for at in range(0, len(i), 1 << 16):
                    a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    exact = np.einsum("ik,ik->i", unit[strip[a]], unit[right[b]])
                    near[a, b] = np.round(exact, 9) >= similarity - 1e-12
            if low[0] == high[0]:
                near &= np.arange(len(right))[None, :] > np.arange(start, start + len(strip))[:, None]
            if near.any():
                found.add(strip, right, near)
        return pa.Table.from_pandas(found.rows(), preserve_index=False)

    mine, last = F.col("block"), F.col("n_blocks") - 1
    if inside and across:
        other = F.explode(F.sequence(F.lit(0), last))
    elif inside:
        other = mine
    else:
        others = F.filter(F.sequence(F.lit(0), last), lambda b: b != mine)
        other = F.explode(others)
    sides = points.withColumn("other", other).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    )
    return sides.drop("other", "n_blocks").groupBy("low", "high").applyInArrow(run, schema)
