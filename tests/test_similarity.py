"""Many-query top-k against a plain ranking."""

import random

import pytest

from faultline.operators.similarity import most_similar_batch

FORM = "vec_id long, embedding array<float>, score string, rank string"


def vectors(n, width, seed):
    rnd = random.Random(seed)
    rows = [[rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(width)] for _ in range(n)]
    # A third of all rows are one vector; some are zero, missing or of another width.
    rows = [rows[0] if i % 3 == 0 else r for i, r in enumerate(rows)]
    rows[5], rows[7], rows[8], rows[9] = [0.0] * width, None, [], [1.0] * (width + 1)
    return [(i * 3, r, "x", "y") for i, r in enumerate(rows)]


def plain(queries, candidates, k, width):
    def unit(v):
        if v is None or len(v) != width:
            return [0.0] * width
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else v

    out = {}
    for q, v, *_ in queries:
        scores = [(-round(sum(a * b for a, b in zip(unit(v), unit(w))), 9), c) for c, w, *_ in candidates]
        for rank, (s, c) in enumerate(sorted(scores)[:k], 1):
            out[q, rank] = (c, -s + 0.0)
    return out


@pytest.mark.parametrize("options", [{}, {"query_bytes": 1500, "block_rows": 40}, {"query_bytes": 2500, "block_rows": 70}])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_equal_to_plain_ranking(spark, options, k):
    rows = vectors(150, 6, 2)
    asked = [r for r in rows[:40] if r[1] is None or len(r[1]) < 7]
    candidates = spark.createDataFrame([*rows, (None, [1.0] * 6, "", "")], FORM).repartition(7)
    queries = spark.createDataFrame(asked, FORM).withColumnRenamed("vec_id", "query_id")
    got = most_similar_batch(queries, candidates, k, **options).collect()
    want = plain(asked, rows, k, 6)
    assert len(got) == len(want)
    for r in got:
        assert (r.vec_id, pytest.approx(r.score, abs=1e-8)) == want[r.query_id, r.rank]


def test_empty_tables(spark):
    some, none = spark.createDataFrame(vectors(12, 3, 1), FORM), spark.createDataFrame([], FORM)
    asked = none.withColumnRenamed("vec_id", "query_id")
    assert most_similar_batch(asked, some).collect() == []
    assert most_similar_batch(some.withColumnRenamed("vec_id", "query_id"), none).collect() == []
