"""Severity readings and header parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline import fixed
from faultline.functions.text import strip


def level_anywhere(col: Column) -> Column:
    """First level word in the text, upper-cased; INFO when there is none.

    WARN stays WARN here; only the header parse folds it into WARNING.
    """
    found = F.regexp_extract(col, rf"(?U)(?i)\b({fixed.LEVEL_WORDS})\b", 1)
    return F.coalesce(F.nullif(F.upper(found), F.lit("")), F.lit("INFO"))


def severity_label(level: Column) -> Column:
    return F.when(level == "WARN", "WARNING").otherwise(level)


def severity_weight(level: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in fixed.SEVERITY_WEIGHT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, level), F.lit(1)).cast("double")


def severity_rank(level: Column) -> Column:
    """Position in the natural severity order; unknown levels sort last."""
    order = F.array(*[F.lit(x) for x in fixed.SEVERITY_ORDER])
    position = F.array_position(order, level)
    return F.when(position > 0, position - 1).otherwise(F.lit(99)).cast("int")


def timeline_height(level: Column) -> Column:
    return (
        F.when(level.isin(fixed.CRITICAL_LEVELS), 4)
        .when(level == "ERROR", 3)
        .when(level.isin("WARNING", "WARN"), 2)
        .otherwise(1)
    )


_STAMP = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"
_HEADER = rf"(?iUs)^{_STAMP}[,\s\[\]]*({fixed.LEVEL_WORDS})?\s*[:\-\]]?\s*(.*)"
_EXTENDED = (
    rf"(?iUs)^\[?{_STAMP}(?:[.,]\d+)?[,\s\[\]]*({fixed.LEVEL_WORDS})?\s*[:\-\]]*\s*(.*)"
)


def parse_header(line: Column, ingest_ts: Column, extended: bool = False) -> dict[str, Column]:
    """Timestamp, level and message of a log line.

    Lines without the header take ``ingest_ts``, INFO and the whole line. The
    extended form also reads a leading bracket and fractional seconds.
    """
    text = strip(line)
    pattern = _EXTENDED if extended else _HEADER
    hit = text.rlike(pattern)
    word = F.upper(F.regexp_extract(text, pattern, 2))
    rest = strip(F.regexp_extract(text, pattern, 3))
    return {
        "timestamp": F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(ingest_ts),
        "level": F.when(hit & (word != ""), severity_label(word)).otherwise(F.lit("INFO")),
        "message": F.when(hit & (rest != ""), rest).otherwise(text),
    }


_STRICT = rf"(?Us)^(\S+)\s+({fixed.STRICT_LEVEL_WORDS})\s+(.*)"


def strict_match(line: Column) -> Column:
    return line.rlike(_STRICT)


def parse_strict(line: Column) -> dict[str, Column]:
    return {
        "timestamp": F.regexp_extract(line, _STRICT, 1),
        "level": F.regexp_extract(line, _STRICT, 2),
        "message": F.regexp_extract(line, _STRICT, 3),
    }
