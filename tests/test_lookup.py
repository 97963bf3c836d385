"""The lookup join, broadcast and dealt out, against a plain dictionary."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import lookup


@pytest.mark.parametrize("options", [{}, {"table_bytes": 0, "hot_rows": 50}, {"table_bytes": 0}])
def test_equal_to_a_dictionary(spark, options):
    # A third of all rows have one key; some have a null key or one that the table lacks.
    rows = [(i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{i % 40}", "x") for i in range(900)]
    table = {"hot": 1, None: 2, **{f"k{i}": 10 + i for i in range(30)}}
    left = spark.createDataFrame(rows, "line_id long, name string, value string").repartition(5)
    right = spark.createDataFrame(list(table.items()), "key string, found int")
    got = lookup.lookup(left, right, {"key": F.col("name")}, **options)
    assert got.columns == ["line_id", "name", "value", "found"]
    want = {(i, n, v, None if n is None else table.get(n)) for i, n, v in rows}
    assert got.count() == 900 and {tuple(r) for r in got.collect()} == want


def test_hot_keys_are_dealt_out(spark):
    rows = spark.range(3000).select(F.col("id").alias("line_id"), F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.lit(1))
    dealt, spread, on = lookup.salted(rows, table, ["k"], F.col("line_id"), hot_rows=100)
    assert on == ["k", "_salt"]
    per_key = dealt.groupBy(*on).count()
    assert per_key.agg(F.max("count")).first()[0] <= 200 and per_key.where("k = 'hot'").count() == 20
    assert spread.groupBy(*on).count().where("count > 1").isEmpty() and dealt.join(spread, on).count() == 3000


def test_empty(spark):
    rows = spark.createDataFrame([], "line_id long, k string")
    table = spark.createDataFrame([], "k string, v int")
    assert lookup.lookup(rows, table, {"k": F.col("k")}).collect() == []
