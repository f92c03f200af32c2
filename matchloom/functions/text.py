"""String and number column functions.

Python's idea of white space is wider than Spark's ``trim`` and Java's ``\\s``,
so the set is spelled out once and used for stripping and for word splitting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

RARE_WHITESPACE = "".join(ch for ch in WHITESPACE if ch not in "\t\n\x0b\x0c\r ")

# Fixed value: a decimal number as Python's float() reads it (digit groups may
# be separated by single underscores; "inf" and "nan" are left out on purpose).
NUMBER_PATTERN = (
    r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
)

# A search token is a run of letters and digits.
NON_TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space at both ends, the way Python's ``str.strip`` does."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normalize_key(c: Column | str) -> Column:
    """Lower-cased and stripped text: the key under which a string is embedded."""
    return strip(F.lower(_col(c)))


def single_spaced(c: Column | str) -> Column:
    """Stripped text with every run of white space turned into one blank."""
    # Java's \\s knows the ASCII ones only; the others are mapped to blanks first.
    blanks = F.translate(_col(c), RARE_WHITESPACE, " " * len(RARE_WHITESPACE))
    return F.btrim(F.regexp_replace(blanks, r"\s+", " "))


def words(c: Column | str) -> Column:
    """White-space separated words, never empty ones."""
    return F.array_remove(F.split(single_spaced(c), " "), "")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in text order, duplicates kept."""
    return F.array_remove(F.split(F.lower(_col(c)), NON_TOKEN_PATTERN), "")


def lenient_int(c: Column | str) -> Column:
    """Number text truncated to BIGINT; anything that is not a number is NULL.

    ``"18 Years"``, ``"NA"``, blanks, infinities and values beyond BIGINT are
    NULL, so aggregates skip them.
    """
    text = strip(_col(c).cast("string"))
    digits = F.when(text.rlike(NUMBER_PATTERN), F.replace(text, F.lit("_"), F.lit("")))
    value = digits.try_cast("double")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    return F.when(F.abs(value) < F.lit(9.2e18), whole.try_cast("bigint"))


def parse_conditions(c: Column | str) -> Column:
    """Comma-separated text to an array of stripped non-blank names; NULL gives []."""
    parts = F.filter(F.transform(F.split(_col(c), ","), strip), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def clean_conditions(c: Column | str) -> Column:
    """Array of condition names to distinct normalised keys, blanks dropped."""
    keys = F.filter(F.transform(_col(c), normalize_key), lambda x: x != "")
    return F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))


def numbered_fields(metadata: Column | str, prefix: str, count_key: str) -> Column:
    """Values of ``{prefix}1 .. {prefix}N`` in order, blanks and gaps skipped.

    N is read from ``count_key``; a missing or non-positive N gives [].
    """
    m = _col(metadata)
    n = F.coalesce(lenient_int(m[count_key]), F.lit(0)).cast("int")
    numbers = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    values = F.transform(numbers, lambda i: m[F.concat(F.lit(prefix), i.cast("string"))])
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.when(n > 0, kept).otherwise(F.array().cast("array<string>"))


def joined_numbered_fields(metadata: Column | str, prefix: str, count_key: str) -> Column:
    return F.array_join(numbered_fields(metadata, prefix, count_key), ", ")


def extract_between(source: Column | str, start: str, end: str | None = None) -> Column:
    """Text after the first ``start`` up to the first ``end`` behind it, stripped.

    No ``start`` gives ``''``; no ``end`` means the rest of the text. Markers are
    case-sensitive.
    """
    src = _col(source)
    rest = F.substring(src, F.locate(start, src) + F.lit(len(start)), F.length(src))
    if end is not None:
        # substring_index would return everything when the marker is absent,
        # which is exactly the "to the end" rule.
        rest = F.substring_index(rest, end, 1)
    return F.when(F.locate(start, src) == 0, F.lit("")).otherwise(strip(rest))
