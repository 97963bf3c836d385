"""Text normalisation and masking as Spark columns."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from faultline import fixed

# Characters outside the decimal digits that still count as digits
# (superscripts, subscripts, circled and parenthesised digits).
_DIGIT = (
    r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨"
    r"⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾"
    r"➀-➈➊-➒፩-፱]"
)
# A token with a digit. It is only looked for at the start of a token, so that long ones are read once.
_DIGIT_TOKEN = rf"(?<![^ ])[^ {_DIGIT[1:]}*+{_DIGIT}[^ ]*+"


def strip(col: Column) -> Column:
    """Drop white space at both ends (any Unicode white space, not only blanks)."""
    return F.regexp_replace(col, f"(?U)^{fixed.WS}+|{fixed.WS}+$", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike("(?U)[^" + fixed.WS[1:])


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    values = text.to_pylist()
    return pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in values], pa.string())


def nfkc(col: Column) -> Column:
    """NFKC form. Pure-ASCII text is already normalised; only the rest is sent to Python."""
    ascii_only = col.rlike(r"^\p{ASCII}*$")
    return F.coalesce(_nfkc(F.when(~ascii_only, col)), col)


def squeeze(col: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(col, f"(?U){fixed.WS}+", " "))


def clean(col: Column, unicode_form: bool = True) -> Column:
    text = F.coalesce(col.cast("string"), F.lit(""))
    return squeeze(nfkc(text) if unicode_form else text)


def truncate(col: Column, limit: int = fixed.MAX_MESSAGE_CHARS) -> Column:
    cut = F.concat(F.substring(col, 1, limit), F.lit(fixed.TRUNCATION_MARK))
    return F.when(F.length(col) > limit, cut).otherwise(col)


def mask(col: Column) -> Column:
    """Replace dates, times, addresses, hex words and numbers, in that order."""
    steps = [
        (fixed.DATE_MASK, "<DATE>"),
        (fixed.TIME_MASK, "<TIME>"),
        (fixed.IP_MASK, "<IP>"),
        (fixed.HEX_MASK, "<HEX>"),
        (fixed.NUM_MASK, "<NUM>"),
    ]
    for pattern, label in steps:
        col = F.regexp_replace(col, "(?U)" + pattern, label)
    return col


def masked_line(col: Column, limit: int | None = None) -> Column:
    """Masked and blank-squeezed text, tokens joined by one blank; truncated first if a limit is set."""
    return squeeze(mask(col if limit is None else truncate(col, limit)))


def tokens(col: Column) -> Column:
    return F.filter(F.split(col, f"(?U){fixed.WS}+"), lambda t: t != "")


def leaf_key(masked: Column) -> Column:
    """Search-tree leaf of a masked line (tokens joined by one blank): token count and
    the first three tokens, any token holding a digit replaced by a wildcard.
    """
    n_words = F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1
    head = F.regexp_replace(F.substring_index(masked, " ", 3), _DIGIT_TOKEN, "<*>")
    return F.concat_ws(" ", n_words.cast("string"), head)


def snippet(col: Column, chars: int) -> Column:
    return F.substring(col, 1, chars)


def embeddable(col: Column) -> Column:
    """Blank texts get a placeholder so that every text has some content."""
    text = F.coalesce(col, F.lit(""))
    return F.when(is_blank(text), F.lit(fixed.EMPTY_TEXT)).otherwise(text)


def terms(col: Column) -> Column:
    """Lower-cased words of two or more characters, then their adjacent pairs."""
    words = F.regexp_extract_all(F.lower(col), F.lit("(?U)(" + fixed.TERM_PATTERN + ")"), 1)

    def with_pairs(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(w, F.lit(1), rest),
            F.slice(w, F.lit(2), rest),
            lambda a, b: F.concat_ws(" ", a, b),
        )
        return F.concat(w, pairs)

    # The one-element array binds the words, so that they are extracted once.
    return F.element_at(F.transform(F.array(words), with_pairs), 1)
