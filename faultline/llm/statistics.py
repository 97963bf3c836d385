"""Counts over the words, lines and characters of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.shared import BLANKS, slices, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile("[0-9]")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_bangs", "n_digits", "n_distinct", "n_stops",
]


def repeated(of_text: list[bytes]) -> int:
    """Words in windows of five that stand twice or more in the text."""
    if len(of_text) <= WINDOW:
        return 0
    hashed = np.fromiter(map(hash, of_text), np.int64, len(of_text)).view(np.uint64)
    n = len(hashed) - WINDOW + 1
    rolled = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        rolled ^= hashed[i : i + n] * _MIX[i]
        rolled ^= rolled >> np.uint64(29)
    order = np.argsort(rolled)
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # A word counts if one of the five windows over it does.
    covered = np.zeros(len(hashed) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text; all 0 for null and for texts without words."""
    of_text = words(text)
    if not of_text:
        return (0, 0, sum(map((text or "").count, SYMBOLS)), *[0] * (len(COUNTS) - 3))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(of_text),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(of_text),
        len(lines),
        len(_CAPITAL.findall(text)),
        text.count("!"),
        len(_DIGIT.findall(text)),
        len(set(of_text)),
        text.count("."),
    )


def with_counts(docs: DataFrame, keep: list[str], text: str | Column = "text") -> DataFrame:
    """The ``keep`` columns (name: output name) of every row and ``COUNTS`` of its whole text."""
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{c} bigint" for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = np.array([counts(t) for t in piece.column("_text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            own = [piece.column(i) for i in range(piece.num_columns - 1)]
            yield pa.record_batch(
                own + [pa.array(found[:, i].copy()) for i in range(len(COUNTS))],
                names=piece.schema.names[:-1] + COUNTS,
            )

    column = F.col(text) if isinstance(text, str) else text
    return docs.select(*keep, column.alias("_text")).mapInArrow(count, schema)
