import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions import levels, text


def one(spark, value, expression):
    row = spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x"))
    return row.first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""),
        ("  a\tb\nc\r\n d  ", "a b c d"),
        ("a  b", "a b"),
        ("ﬁle ①", "file 1"),
        ("café", "café"),
        ("\x1cx\x1f", "x"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, text.clean) == want


def test_clean_many_against_python(spark):
    words = ["a", "Ä", "Ω", "ＡＢ", "١", "\t", " ", "  ", "x́"]
    rows = [("".join(words[(i * k) % 9] for k in range(1, 8)),) for i in range(60)]
    got = spark.createDataFrame(rows, "t string").select("t", text.clean(F.col("t")).alias("c"))
    for row in got.collect():
        assert row.c == " ".join(unicodedata.normalize("NFKC", row.t).split())


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2026-01-15 12:34:56.789 x 10.0.0.1 0xFF 42", "<DATE> <TIME> x <IP> <HEX> <NUM>"),
        ("2026/01/15", "<DATE>"),
        ("2026-01-15T12:34:56", "<NUM>-<NUM>-15T12:<NUM>:<NUM>"),
        ("45ms ORD-7 /a/9", "45ms ORD-<NUM> /a/<NUM>"),
        ("12é ١٢", "12é <NUM>"),
    ],
)
def test_mask(spark, raw, want):
    assert one(spark, raw, text.mask) == want


def test_truncate(spark):
    assert one(spark, "A" * 15000, text.truncate) == "A" * 10000 + " ...[TRUNCATED]"
    assert one(spark, "A" * 10000, text.truncate) == "A" * 10000


def test_tokens_and_leaf(spark):
    assert one(spark, " a  b\tc ", text.tokens) == ["a", "b", "c"]
    assert one(spark, "a b2 c d", text.leaf_key) == "4 a <*> c"
    assert one(spark, "a² b", text.leaf_key) == "2 <*> b"


def test_terms(spark):
    assert one(spark, "Ab c DE_f <NUM>", text.terms) == [
        "ab", "de_f", "num", "ab de_f", "de_f num",
    ]
    assert one(spark, "a b", text.terms) == []
    assert one(spark, "", text.terms) == []


def test_embeddable(spark):
    assert one(spark, " \t", text.embeddable) == "[EMPTY]"


@pytest.mark.parametrize(
    "raw, want",
    [("an error here", "ERROR"), ("Warn me", "WARN"), ("errors", "INFO"), ("", "INFO"),
     ("x DEBUG then FATAL", "DEBUG")],
)
def test_level_anywhere(spark, raw, want):
    assert one(spark, raw, levels.level_anywhere) == want


HEADERS = [
    ("2026-01-15 12:34:56 ERROR  it broke", "2026-01-15 12:34:56", "ERROR", "it broke"),
    ("2026-01-15T12:34:56 [WARNING] x", "2026-01-15T12:34:56", "WARNING", "x"),
    ("2026-01-15 12:34:56 WARN: x", "2026-01-15 12:34:56", "WARNING", "x"),
    ("2026-01-15 12:34:56 fatal - x", "2026-01-15 12:34:56", "FATAL", "x"),
    ("[2026-01-15 12:34:56] INFO: x", "now", "INFO", "[2026-01-15 12:34:56] INFO: x"),
    ("2026-01-15 12:34:56,123 ERROR x", "2026-01-15 12:34:56", "INFO", "123 ERROR x"),
    ("2026-01-15 12:34:56 ERROR", "2026-01-15 12:34:56", "ERROR", "2026-01-15 12:34:56 ERROR"),
    ("  plain text ", "now", "INFO", "plain text"),
]


@pytest.mark.parametrize("line, ts, level, message", HEADERS)
def test_header(spark, line, ts, level, message):
    parts = levels.parse_header(F.col("t"), F.lit("now"))
    row = spark.createDataFrame([(line,)], "t string").select(
        *[v.alias(k) for k, v in parts.items()]
    ).first()
    assert tuple(row) == (ts, level, message)


def test_header_extended(spark):
    parts = levels.parse_header(F.col("t"), F.lit("now"), extended=True)
    lines = ["[2026-01-15 12:34:56] INFO: x", "2026-01-15 12:34:56,123 ERROR x"]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select(
        *[v.alias(k) for k, v in parts.items()]
    )
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("2026-01-15 12:34:56", "ERROR", "x"), ("2026-01-15 12:34:56", "INFO", "x"),
    ]


def test_strict(spark):
    lines = [("t1 ERROR a b",), ("t1 FATAL a",), ("t1 error a",), (" ERROR a",)]
    df = spark.createDataFrame(lines, "t string").where(levels.strict_match(F.col("t")))
    rows = df.select(*[v.alias(k) for k, v in levels.parse_strict(F.col("t")).items()]).collect()
    assert [tuple(r) for r in rows] == [("t1", "ERROR", "a b")]


def test_severity_columns(spark):
    df = spark.createDataFrame([(x,) for x in [*fixed.SEVERITY_ORDER, "ODD"]], "l string")
    rows = df.select(
        "l",
        levels.severity_weight(F.col("l")).alias("w"),
        levels.severity_rank(F.col("l")).alias("r"),
        levels.timeline_height(F.col("l")).alias("y"),
        levels.severity_label(F.col("l")).alias("s"),
    ).collect()
    assert [r.w for r in rows] == [0, 1, 2, 2, 3, 4, 4, 1]
    assert [r.r for r in rows] == [0, 1, 2, 3, 4, 5, 6, 99]
    assert [r.y for r in rows] == [1, 1, 2, 2, 3, 4, 4, 1]
    assert rows[3].s == "WARNING"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \t ١.:-x", max_size=30), min_size=1, max_size=20))
def test_squeeze_equals_split_join(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    for row in df.select("t", text.squeeze(F.col("t")).alias("s")).collect():
        assert row.s == " ".join(row.t.split())


def test_leaf_and_blank_equal_the_words(spark):
    words = ["a", "b2", "c²", "x١y", "٣", "é", "<NUM>", "<*>", "½", "a" * 30_000, "b" * 30_000 + "7", "$1"]
    rows = [" ".join(words[(i * k + k) % 12] for k in range(1, 1 + i % 6)) for i in range(60)]
    rows += ["", " ", "a ", " a", "a  b2", "\x1c\x1f", " ", "\x85\n", "\n", "x\n", "​", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for r in df.select("t", text.leaf_key(F.col("t")).alias("k"), text.is_blank(F.col("t")).alias("b")).collect():
        if r.t is None:
            assert (r.k, r.b) == ("", None)
            continue
        head = ["<*>" if any(c.isdigit() for c in w) else w for w in r.t.split(" ")[:3]]
        assert r.k == " ".join([str(r.t.count(" ") + 1), *head])
        assert r.b == (not r.t.strip())
