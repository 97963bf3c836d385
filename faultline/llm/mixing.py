"""Mixing sources to target weights by weighted fair queueing.

Every document, in a shuffled order of its source, finishes at the source's words so
far divided by the source's target. Documents of all sources, further epochs
included, are then taken in the order of their finish time until the budget is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.shared import WORD, free_names, running_sum
from faultline.session import cut

MOST_EPOCHS = 3
FINISH_BUCKETS = 4096


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight and target of each source; works on one row per source.

    Sources stand by code point, null last, and weigh ``weights`` in turn. A target
    is the smaller of ``epochs`` times the source's size and its weight times one
    common level, chosen so that targets add up to all sizes: what resharing the
    excess by weight again and again ends with.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    sizes = sizes.withColumn("weight", weight).withColumn("_most", epochs * F.col("source_size"))
    earlier = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_most").over(earlier), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    )
    sizes = sizes.withColumn("_level", level)
    reached = F.when(F.col("_most") >= F.col("_level") * F.col("weight"), F.col("_level"))
    # Past the first source below its most the level only falls again: the first is the highest.
    common = F.max(reached).over(every)
    target = F.least(F.col("_most").cast("double"), F.coalesce(common * F.col("weight"), F.col("_most").cast("double")))
    return sizes.select("source", "source_size", "weight", target.alias("target"))


def _digest() -> Column:
    return F.xxhash64("text", "source")


def sized_rows(docs: DataFrame, seed: int) -> DataFrame:
    """Narrow rows with a row number of their own, word counts and the shuffling key."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(
        "doc_id", "source", size.alias("size"), key.alias("key"), _digest().alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def fair_queue(rows: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Rows with their source's size and target, and the copies taken, each with its finish time."""
    targets = cut(source_targets(rows))
    joined = running_sum(
        rows.withColumn("_bucket", F.substring("key", 1, 3)), ["source"], "_bucket", ["key", "doc_id", "row"],
        "size", "upto",
    ).drop("_bucket")
    same = joined["source"].eqNullSafe(targets["source"])
    queued = cut(joined.join(targets, same).drop(targets["source"]))
    finish = (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")
    copies = (
        queued.where(F.col("size") > 0)
        .withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(MOST_EPOCHS)])))
        .where(F.col("epoch") * F.col("source_size") + F.col("upto") - F.col("size") < F.col("target"))
        .withColumn("finish", finish)
        .withColumn(
            "_bucket", F.floor(F.least(F.col("finish"), F.lit(2.0)) * FINISH_BUCKETS).cast("int")
        )
        .select("row", "source", "size", "epoch", "finish", "key", "_bucket")
    )
    placed = running_sum(
        copies, [], "_bucket", ["finish", F.col("source").asc_nulls_last(), "epoch", "key", "row"], "size", "place"
    )
    budget = F.lit(rows.agg(F.sum("size")).first()[0] or 0)
    return queued, placed.where(F.col("place") <= budget).drop("_bucket")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    The text's words are the size, none for null; null sources are a source of
    their own, the last. Rows without words take nothing. Rows stay apart even when
    they repeat an id; an empty table gives no rows. The order depends on ids and
    ``seed`` alone.
    """
    rows = cut(sized_rows(docs, seed))
    queued, copies = fair_queue(rows, seed)
    taken = copies.groupBy("row").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("times"))
    return queued.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("times", F.lit(0)).alias("times"),
    )


def repeated_rows(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows without words go.

    Of rows that repeat id, text and source, one carries the copies of all. Null ids and sources
    count as in ``mix``; an empty table gives no rows and other columns may have any name.
    """
    rows = cut(sized_rows(docs, seed))
    _, copies = fair_queue(rows, seed)
    times = copies.join(rows.select("row", "doc_id", "digest"), "row")
    id, own, other, n, first, copy = free_names(docs, "_id", "_digest", "_other", "_times", "_first", "_copy")
    times = times.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias(n))
    times = times.select(F.col("doc_id").alias(id), F.col("digest").alias(other), n)
    named = docs.withColumn(own, _digest())
    joined = named.join(times, F.col("doc_id").eqNullSafe(F.col(id)) & (F.col(own) == F.col(other)))
    one = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(own)) == 1
    joined = joined.withColumn(first, one).where(F.col(first))
    each = F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(copy)
    return joined.select(*docs.columns, each).drop(copy)
