"""Shards of nearly equal size that keep equal texts together: a minimax contiguous partition.

Groups of equal texts stand in the order of their digest. The smallest capacity for
which cutting greedily needs no more than the wanted shards is searched between
the largest group (or the mean, if larger) and that plus the largest group: 31
capacities at a time, five halvings in a pass, each filled greedily by looking up
the furthest group end that it reaches.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, functions as F

from faultline.llm.shared import running_sum
from faultline.session import cut

PROBES = 31


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size in UTF-8 bytes plus one, crc32 and group digest of each text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("group"),
    )


class Ends:
    """Ends of the ordered groups, looked up in the one or two buckets that can hold them."""

    def __init__(self, ends: DataFrame):
        self.ends = ends
        rows = ends.groupBy("bucket").agg(F.max("upto").alias("upto")).orderBy("upto").collect()
        self.last = [r["upto"] for r in rows]
        self.names = [r["bucket"] for r in rows]

    def reached(self, limits: list[int]) -> list[int]:
        """For each limit the largest group end that does not exceed it, 0 if none."""
        at = [bisect.bisect_right(self.last, limit) for limit in limits]
        known = [self.last[i - 1] if i else 0 for i in at]
        inside = {self.names[i] for i in at if i < len(self.names)}
        if not inside:
            return known
        found = (
            self.ends.where(F.col("bucket").isin(sorted(inside)))
            .agg(*[F.max(F.when(F.col("upto") <= limit, F.col("upto"))) for limit in limits])
            .first()
        )
        return [max(a, b or 0) for a, b in zip(known, found)]

    def fill(self, capacities: list[int], shards: int, total: int) -> list[list[int]]:
        """Greedy cuts for each capacity: the end of every shard but the last."""
        cuts: list[list[int]] = [[] for _ in capacities]
        for _ in range(shards - 1):
            limits = [(c[-1] if c else 0) + cap for c, cap in zip(cuts, capacities)]
            for c, end in zip(cuts, self.reached(limits)):
                c.append(min(end, total))
        return cuts


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the greedy cuts under it."""
    sums = ends.agg(F.max("upto"), F.max("bytes")).first()
    total, largest = sums[0] or 0, sums[1] or 0
    low, high = max(-(-total // shards), largest), max(-(-total // shards), largest) + largest
    table = Ends(ends)
    while low < high:
        tried = sorted({low + (high - low) * i // (PROBES + 1) for i in range(PROBES + 1)})
        fits = [total - c[-1] <= cap for c, cap in zip(table.fill(tried, shards, total), tried)]
        if True in fits:
            first = fits.index(True)
            high = tried[first]
            low = tried[first - 1] + 1 if first else high
        else:
            low = tried[-1] + 1
    return high, table.fill([high], shards, total)[0]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot of every row.

    Null texts count as empty and share the group of empty texts; an empty table
    gives no rows. Repeated rows and null ids are rows like any other. The widest
    shard is as small as contiguous groups allow; a group larger than a shard's
    share sets that width. Slots follow a hash of the id, so that a group of any
    size is numbered in many tasks.
    """
    if shards < 2:
        raise ValueError("at least two shards")
    rows = cut(sized(docs))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("bucket", F.substring("group", 1, 3))
    ends = cut(running_sum(groups, [], "bucket", ["group"], "bytes", "upto"))
    _, cuts = minimax_cuts(ends, shards)
    last = {r["upto"]: r["group"] for r in ends.where(F.col("upto").isin(sorted(set(cuts)))).collect()}
    shard = F.lit(0)
    for end in cuts:
        # A cut before the first group puts every group behind it.
        shard = shard + (F.col("group") > F.lit(last.get(end, ""))).cast("int")
    placed = rows.withColumn("shard", shard).withColumns(
        {"_bucket": F.pmod(F.xxhash64("doc_id", "group"), F.lit(1024)).cast("int"), "_one": F.lit(1)}
    )
    placed = running_sum(placed, ["shard"], "_bucket", ["doc_id", "group"], "_one", "_upto")
    return placed.select("doc_id", "size", "text_crc32", "group", "shard", (F.col("_upto") - 1).alias("slot"))
