"""Dense embeddings: batch embedding, pooling and top-k by cosine, for one query or a table of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.functions.text import embeddable

# Bytes of query vectors that every task of a search holds.
QUERY_BYTES = 32 * 1024 * 1024
# Candidates that a task holds at a time when it meets more queries than that.
BLOCK_ROWS = 20_000
# Scores are compared at so many decimals, so that the order of additions decides nothing.
SCORE_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, added up in index order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def most_similar(
    candidates: DataFrame, query: list[float], top_k: int = 3, vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``top_k`` candidates nearest to one query vector.

    The query is a literal: one map-side pass with a top-k on every partition.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    return (
        candidates.select(F.col(vec_id), cosine(F.col(embedding), literal).alias("score"))
        .orderBy(F.desc("score"), vec_id)
        .limit(top_k)
    )


def _unit(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length; nulls, other widths than ``width`` and zero vectors are all zeros."""
    lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(int)
    good = np.flatnonzero(lengths == width)
    rows = np.zeros((len(vectors), width))
    if len(good) and width:
        values = vectors.take(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        rows[good] = np.nan_to_num(values.reshape(len(good), width))
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norms > 0, norms, 1)[:, None]


class _Best:
    """The best ``k`` candidates of each query so far; two of them merge to the best of both."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(self.queries), 1024):
            part = slice(start, start + 1024)
            close = np.round(self.queries[part] @ rows.T, SCORE_DECIMALS) + 0.0
            if close.shape[1] > self.k:
                # All that tie with the last place stay: ids decide among them.
                least = np.partition(close, -self.k, axis=1)[:, -self.k]
                close[close < np.maximum(least, self.scores[part, -1])[:, None]] = -np.inf
            query, place = np.nonzero(close > -np.inf)
            scores = np.concatenate([self.scores[part].ravel(), close[query, place]])
            every = np.concatenate([self.ids[part].ravel(), ids[place]])
            owner = np.concatenate([np.repeat(np.arange(len(close)), self.k), query])
            order = np.lexsort([every, -scores, owner])
            owner, rank = owner[order], np.arange(len(order))
            first = np.searchsorted(owner, np.arange(len(close)))
            kept = rank - first[owner] < self.k
            self.scores[part] = scores[order][kept].reshape(-1, self.k)
            self.ids[part] = every[order][kept].reshape(-1, self.k)

    def rows(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        query, place = np.nonzero(self.scores > -np.inf)
        for start in range(0, len(query), 100_000):
            at = query[start : start + 100_000], place[start : start + 100_000]
            yield pa.record_batch(
                [pa.array(query_ids[at[0]]), pa.array(self.ids[at]), pa.array(self.scores[at])],
                names=["query_id", "vec_id", "score"],
            )


_FOUND = "query_id long, vec_id long, score double"


def most_similar_batch(
    queries: DataFrame, candidates: DataFrame, top_k: int = 3, query_bytes: int = QUERY_BYTES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``top_k`` nearest candidates of every query by cosine.

    ``queries`` has query_id and embedding, ``candidates`` vec_id and embedding (longs, arrays of
    numbers). Every task keeps no more than ``top_k`` candidates of a query and hands those on,
    whatever the number of candidates; the tasks' lists merge in a last ranking. The measured
    size of the queries decides how they meet: up to ``query_bytes`` they go to all tasks, more are
    cut into pieces that meet blocks of ``block_rows`` candidates. Equal scores (to nine decimals)
    stand by vec_id. Null or zero vectors and those of another width have score 0 to all; rows without an
    id are left out; repeated query ids rank each of their rows' candidates together.
    """
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    near = candidates.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    width = max(width, 0)
    pieces = max(1, -(-n * (width + 2 * top_k) * 8 // query_bytes))
    if pieces == 1:
        held = asked.orderBy("query_id").toArrow()
        query_ids = held.column("query_id").to_numpy()
        told = queries.sparkSession.sparkContext.broadcast(
            (query_ids, _unit(held.column("embedding").combine_chunks(), width))
        )

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, vectors = told.value
            best = _Best(vectors, top_k)
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    best.add(part.column("vec_id").to_numpy(), _unit(part.column("embedding"), width))
            yield from best.rows(query_ids)

        found = near.mapInArrow(search, _FOUND)
    else:
        blocks = max(1, -(-near.count() // block_rows))
        mine = asked.withColumn("piece", F.pmod(F.xxhash64("query_id"), F.lit(pieces))).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        theirs = near.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
            "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long")))
        )

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            best = _Best(_unit(a.column("embedding").combine_chunks(), width), top_k)
            for batch in b.to_batches(max_chunksize=4096):
                best.add(batch.column("vec_id").to_numpy(), _unit(batch.column("embedding"), width))
            found = list(best.rows(a.column("query_id").to_numpy()))
            return pa.Table.from_batches(found, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        found = mine.groupBy("piece", "block").cogroup(theirs.groupBy("piece", "block")).applyInArrow(meet, _FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def mean_pool(rows: DataFrame, key: str, embedding: str) -> DataFrame:
    """Mean vector per key of the vectors on its rows.

    Positions are averaged one by one, with partial sums before the shuffle, so a
    key holding any number of rows never meets in one task.
    """
    return (
        rows.select(key, F.posexplode(embedding).alias("position", "x"))
        .groupBy(key, "position")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("position", "x"))).alias("p"))
        .select(key, F.col("p.x").alias("pooled"))
    )


def pool_tokens(tokens: Column) -> Column:
    """Mean over the token vectors of one text (array of arrays)."""
    width = F.size(tokens[0])
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda k: F.aggregate(
            tokens, F.lit(0.0), lambda total, t: total + F.get(t, k).cast("double")
        )
        / F.size(tokens),
    )


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean over the token vectors whose mask is 1; at least one is divided by."""
    kept = F.greatest(F.aggregate(mask, F.lit(0), lambda n, x: n + x.cast("int")), F.lit(1))
    width = F.size(tokens[0])
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda k: F.aggregate(
            F.zip_with(tokens, mask, lambda t, m: F.get(t, k).cast("double") * m.cast("double")),
            F.lit(0.0),
            lambda total, x: total + x,
        )
        / kept,
    )


def embed(
    texts: DataFrame,
    encode: Callable[[list[str]], object],
    text: str = "text",
    batch_size: int = 32,
) -> DataFrame:
    """Add ``embedding`` by running ``encode`` (texts -> matrix) inside the tasks."""
    rows = texts.withColumn("_safe", embeddable(F.col(text)))

    def run(batches):
        for batch in batches:
            values = batch.column("_safe").to_pylist()
            vectors = []
            for start in range(0, len(values), batch_size):
                vectors.extend(
                    [float(x) for x in vector] for vector in encode(values[start : start + batch_size])
                )
            yield batch.append_column("embedding", pa.array(vectors, pa.list_(pa.float64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, embedding array<double>").drop("_safe")
