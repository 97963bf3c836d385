"""Smoothed risk along the lines of each log.

The smoothing window grows with the log (one fortieth of its rows), so it is not
computed as a sliding frame. Scores are turned into prefix sums and every row
subtracts two of them, found by equi-joins on the row position:

* positions and prefix sums come from bounded line-id buckets plus the prefix
  sums of the bucket table, taken in groups of buckets and over the groups, so no
  window ever spans a whole log;
* both joins are on (key, position), which is unique, so they do not skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultline.session import cut

BUCKET_LINES = 65_536
GROUP_BUCKETS = 4_096


def _offsets(per_bucket: DataFrame, keys: list[str], group_buckets: int) -> DataFrame:
    """Rows and sum before each bucket, and all rows of its keys, by two levels of prefix sums.

    A window holds the buckets of one group, another one row for each group.
    """
    per_bucket = cut(per_bucket.withColumn("_g", F.floor(F.col("_b") / group_buckets)))
    per_group = per_bucket.groupBy(*keys, "_g").agg(F.sum("_bn").alias("_gn"), F.sum("_bs").alias("_gs"))

    def before(column: str, parts: list[str], order: str) -> Column:
        earlier = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    groups = per_group.select(
        *keys,
        "_g",
        before("_gn", keys, "_g").alias("_gon"),
        before("_gs", keys, "_g").alias("_gos"),
        F.sum("_gn").over(W.partitionBy(*keys)).alias("n_rows"),
    )
    return per_bucket.select(
        *keys, "_b", "_g", before("_bn", [*keys, "_g"], "_b").alias("_n"), before("_bs", [*keys, "_g"], "_b").alias("_s")
    ).join(groups, [*keys, "_g"]).select(
        *keys, "_b", (F.col("_gon") + F.col("_n")).alias("_on"), (F.col("_gos") + F.col("_s")).alias("_os"), "n_rows"
    )


def with_position(
    rows: DataFrame,
    keys: list[str],
    value: str,
    bucket_lines: int = BUCKET_LINES,
    group_buckets: int = GROUP_BUCKETS,
) -> DataFrame:
    """Add the 1-based position by line_id and the running sum of ``value`` (a bigint).

    Line ids are unique within the keys, so a bucket holds at most
    ``bucket_lines`` rows whatever the size of the log.
    """
    bucketed = rows.withColumn("_b", F.floor(F.col("line_id") / bucket_lines))
    offsets = _offsets(
        bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn"), F.sum(value).alias("_bs")), keys, group_buckets
    )
    inside = W.partitionBy(*keys, "_b").orderBy("line_id")
    return (
        bucketed.join(offsets, [*keys, "_b"])
        .withColumn("pos", F.col("_on") + F.row_number().over(inside))
        .withColumn("running", F.col("_os") + F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .drop("_b", "_on", "_os")
    )


def risk_trend(logs: DataFrame, keys: list[str], bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """Centred rolling mean of the score, scaled to 0..1 per log, with its bands."""
    units = logs.select(
        *keys, "line_id", F.bround(F.col("anomaly_score") * 10000).cast("bigint").alias("_u")
    )
    placed = with_position(units, keys, "_u", bucket_lines)
    width = F.greatest(F.lit(5), F.floor(F.col("n_rows") / 40))
    # Read three times below; a written table keeps the windows from running again.
    placed = cut(placed)
    placed = (
        placed.withColumn("_hi", F.least(F.col("n_rows"), F.col("pos") + F.floor((width - 1) / 2)))
        .withColumn("_lo", F.greatest(F.lit(0), F.col("pos") - F.floor(width / 2) - 1))
    )
    ends = placed.select(*keys, F.col("pos").alias("_hi"), F.col("running").alias("_top"))
    starts = placed.select(*keys, F.col("pos").alias("_lo"), F.col("running").alias("_bottom"))
    smoothed = (
        placed.join(ends, [*keys, "_hi"])
        .join(starts, [*keys, "_lo"], "left")
        .select(
            *keys,
            "line_id",
            (
                (F.col("_top") - F.coalesce(F.col("_bottom"), F.lit(0)))
                / (F.col("_hi") - F.col("_lo"))
                / 10000
            ).alias("smoothed_risk"),
        )
    )
    smoothed = cut(smoothed)
    span = smoothed.groupBy(*keys).agg(
        F.min("smoothed_risk").alias("_min"), F.max("smoothed_risk").alias("_max")
    )
    scaled = (F.col("smoothed_risk") - F.col("_min")) / F.greatest(
        F.col("_max") - F.col("_min"), F.lit(1e-6)
    )
    return (
        smoothed.join(span, keys)
        .withColumn("normalized_risk", scaled)
        .select(
            *keys,
            "line_id",
            "smoothed_risk",
            "normalized_risk",
            F.least("normalized_risk", F.lit(0.4)).alias("low_band"),
            F.greatest("normalized_risk", F.lit(0.7)).alias("high_band"),
        )
    )
