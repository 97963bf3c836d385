import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import templates
from faultline.operators.templates import mine_templates

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]


def replay(rows):
    """Line-by-line replay of one source, on already masked text."""
    leaves, ids, out = {}, 0, {}
    for line, text in sorted(rows):
        words = text.split()
        if not words:
            out[line] = (0, "[EMPTY_LOG]")
            continue
        key = (len(words), *("<*>" if any(c.isdigit() for c in w) else w for w in words[:3]))
        groups = leaves.setdefault(key, [])
        shares = [sum(a == b for a, b in zip(words, g[1])) / len(words) for g in groups]
        if shares and max(shares) >= 0.5:
            group = groups[shares.index(max(shares))]
            group[1] = [a if a == b else "<*>" for a, b in zip(group[1], words)]
        else:
            ids += 1
            group = [ids, words]
            groups.append(group)
        out[line] = (group[0], " ".join(group[1]))
    return out


def frame(spark, sources):
    rows = [(s, line, text) for s, lines in sources.items() for line, text in lines]
    return spark.createDataFrame(rows, "log_source string, line_id long, clean_log string")


def mined(df, **options):
    rows = mine_templates(df, **options).collect()
    return {(r.log_source, r.line_id): (r.event_id, r.event_template) for r in rows}


def sources(n, seed):
    rnd = random.Random(seed)

    def line():
        head = [rnd.choice(["a", "b"]), "x", "y"]
        return " ".join(head + [rnd.choice(WORDS[: rnd.choice([2, 3, 8])]) for _ in range(rnd.choice([3, 4, 5]))])

    return {
        # One source holds most of the lines.
        "big": [(i * 2 + 1, line()) for i in range(n)],
        "small": [(i + 1, line() if i % 9 else "  ") for i in range(n // 10)],
    }


@pytest.mark.parametrize("options", [
    {},
    {"hot_rows": 60},
    {"hot_rows": 60, "history_bytes": 20_000},
    {"hot_rows": 0},
])
@pytest.mark.parametrize("partitions", [1, 7])
def test_equal_to_replay(spark, options, partitions):
    data = sources(900, 3)
    want = {(s, k): v for s, rows in data.items() for k, v in replay(rows).items()}
    got = mined(frame(spark, data).repartition(partitions), **options)
    assert got == want


def test_small_blocks_and_ranges(spark, monkeypatch):
    """Many ranges of lines, blocks of versions and shares of a block give the same."""
    monkeypatch.setattr(templates, "BUCKET_LINES", 64)
    monkeypatch.setattr(templates, "TASK_ROWS", 20)
    data = sources(900, 5)
    want = {(s, k): v for s, rows in data.items() for k, v in replay(rows).items()}
    assert mined(frame(spark, data), hot_rows=30, history_bytes=1) == want


def test_masks_and_ids(spark):
    lines = [(1, "Connection refused from 10.0.0.1 on port 22"), (2, ""), (3, "   "),
             (4, "Connection refused from 192.168.1.5 on port 80"), (5, "A" * 15000)]
    got = mined(frame(spark, {"s": lines}))
    assert got[("s", 1)] == got[("s", 4)] == (1, "Connection refused from <IP> on port <NUM>")
    assert got[("s", 2)] == got[("s", 3)] == (0, "[EMPTY_LOG]")
    assert got[("s", 5)] == (2, "A" * 15000)
    got = mined(frame(spark, {"s": lines}), max_chars=10_000)
    assert got[("s", 5)] == (2, "A" * 10000 + " ...[TRUNCATED]")


def test_template_is_as_of_the_line(spark):
    lines = [(1, "get page one from host"), (2, "get page one to host"), (3, "get page one from host")]
    got = mined(frame(spark, {"s": lines}))
    assert [got[("s", i)][1] for i in (1, 2, 3)] == [
        "get page one from host", "get page one <*> host", "get page one <*> host",
    ]


def test_level_and_other_columns_stay(spark):
    df = spark.createDataFrame(
        [("s", 1, "x WARN y", 7)], "log_source string, line_id long, clean_log string, extra int"
    )
    row = mine_templates(df).first()
    assert (row.level, row.extra, row.event_id) == ("WARN", 7, 1)


@pytest.mark.parametrize("hot_rows", [5, 1_000])
def test_masks_are_worked_out_once_a_row(spark, monkeypatch, hot_rows):
    calls, n = spark.sparkContext.accumulator(0), 60
    rows = [(f"{'x' * (i % 3 + 1)} {'y' if i % 2 else 'z'} w{i}") for i in range(n)]
    want = {("s", i): found for i, found in replay(list(enumerate(rows))).items()}

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    monkeypatch.setattr(templates, "masked_line", lambda col, limit=None: counted(col))
    df = spark.createDataFrame([("s", i, text) for i, text in enumerate(rows)], "log_source string, line_id long, clean_log string")
    assert mined(df, hot_rows=hot_rows) == want
    assert calls.value == n
