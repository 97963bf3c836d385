"""Helpers of this subpackage: words, Arrow slices and running sums without a single task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Words are the longest runs of other characters than these.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as ``df`` needs to have no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` parts at exactly the six blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def single_blanks(text: str) -> bool:
    """Whether the text has words and every white space stands alone between two of them."""
    parts = text.split()
    return bool(parts) and len("".join(parts)) + len(parts) - 1 == len(text)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that only few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def running_sum(
    df: DataFrame, group: list[str], bucket: str, order: list[str | Column], value: str, out: str
) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row, by ``bucket`` and ``order``.

    The order is kept within each combination of ``group``. Rows meet only within a
    bucket; what lies before a bucket is summed over the table of bucket totals, so
    the number of buckets must be bounded and no bucket may hold most of the rows.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    before = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, bucket])],
        F.coalesce(
            F.sum("_total").over(
                Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*group, bucket])]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    inside = (
        Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        df.join(before, condition)
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_before", *[f"_k{i}" for i in range(len(group) + 1)])
    )
