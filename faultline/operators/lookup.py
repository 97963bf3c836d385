"""Put a value of its key on every row, whatever share of the rows one key holds.

The table's size is measured. Up to a bound it is broadcast and no row moves; a larger one is
joined by a shuffle in which rows of frequent keys are dealt over several copies of their
table row, so that no task gets all of them. Frequent keys are counted exactly and are at
most ``MOST_HOT``, as each holds more than that part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from faultline.session import cut

TABLE_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000
MOST_HOT = 10_000


def _bytes(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 16
    return F.lit(16)


def salted(rows: DataFrame, table: DataFrame, keys: list[str], salt_by: Column, hot_rows: int = HOT_ROWS):
    """(rows, table, keys) with one more key that deals the rows of each frequent key over copies of its table row."""
    counts = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    most = max(hot_rows, total // MOST_HOT)
    hot = cut(counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_copies")))
    copies = F.coalesce("_copies", F.lit(1))
    # At most MOST_HOT rows, by the bound above.
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), copies).cast("int"))
    spread = table.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.drop("_copies"), spread.drop("_copies"), [*keys, "_salt"]


def lookup(
    rows: DataFrame, table: DataFrame, keys: dict[str, Column], salt_by: str = "line_id",
    table_bytes: int = TABLE_BYTES, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``rows`` with the other columns of ``table``, null where it has no such key.

    ``keys`` gives, for each key column of the table, the expression over a row that must be equal
    to it; the table holds a key once, and null keys match nothing. ``salt_by`` is a column whose values
    differ among rows of one key. The table is written first, as it is measured and then read.
    """
    values = [c for c in table.columns if c not in keys]
    named = table.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *values)
    named = cut(named.where(" and ".join(f"`_key_{k}` is not null" for k in keys)))
    size = named.agg(F.coalesce(F.sum(sum((_bytes(f) for f in named.schema.fields), F.lit(0))), F.lit(0))).first()[0]
    on = [f"_key_{k}" for k in keys]
    asked = rows.withColumns({f"_key_{k}": c for k, c in keys.items()})
    if size <= table_bytes:
        return asked.join(F.broadcast(named), on, "left").drop(*on)
    asked, named, on = salted(asked, named, on, F.col(salt_by), hot_rows)
    return asked.join(named, on, "left").drop(*on)
