"""Keyword rules as generated CASE expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline import fixed


def _holds_any(text: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


def _first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    picked = F.lit(otherwise)
    for test, value in reversed(cases):
        picked = F.when(test, F.lit(value)).otherwise(picked)
    return picked


def rule_cause(message: Column) -> Column:
    """Cause of the first rule with a keyword anywhere in the lower-cased text."""
    text = F.lower(message)
    cases = [(_holds_any(text, words), cause) for _, words, cause in fixed.CAUSE_RULES]
    return _first_match(cases, fixed.UNKNOWN_CAUSE)


def rule_family(message: Column) -> Column:
    """Family code of the same rule: one code for every wording of a cause."""
    text = F.lower(message)
    cases = [(_holds_any(text, words), family) for family, words, _ in fixed.CAUSE_RULES]
    return _first_match(cases, "OTHER")


def recommended_action(cause: Column) -> Column:
    text = F.lower(cause)
    cases = [(text.contains(key), action) for key, action in fixed.ACTION_KEYS]
    return _first_match(cases, fixed.UNKNOWN_ACTION)


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Non-overlapping occurrences of all the words, added up."""
    lowered = F.lower(text)
    total = F.lit(0)
    for word in words:
        removed = F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit("")))
        total = total + (removed / len(word)).cast("bigint")
    return total.cast("bigint")
