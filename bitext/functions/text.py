"""Text expressions: whitespace strip, tokens, null literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()),
# written as one regex class that Java regex and RE2 read the same way.
WS_CLASS = ("[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
STRIP_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"

# Token rule: lower case, split on anything that is not a letter, mark or
# digit of any script, drop empties.
WORD_SPLIT = r"[^\p{L}\p{M}\p{N}]+"
HAS_WORD = r"[\p{L}\p{M}\p{N}]"
# ROUGE-L's public definition knows ASCII letters and digits only.
ASCII_SPLIT = "[^a-z0-9]+"

# Strings pandas.read_csv treats as missing by default.
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove all leading/trailing whitespace
    (``trim`` removes spaces only)."""
    return F.regexp_replace(_c(c), STRIP_RE, "")


def not_blank(c) -> Column:
    """True where the text is non-null and non-empty after stripping."""
    s = strip(c)
    return s.isNotNull() & (s != "")


def tokens(c, split: str = WORD_SPLIT) -> Column:
    """array<string> of lower-case word tokens."""
    # a filter lambda measured ~6x faster than array_remove on token arrays
    return F.filter(F.split(F.lower(_c(c)), split), lambda x: x != "")


def stringify_null(c, literal: str = "None") -> Column:
    """``str(x)`` over a possibly-null value: null becomes ``literal``."""
    return F.coalesce(_c(c).cast("string"), F.lit(literal))


def na_to_null(c, na_values=PANDAS_NA) -> Column:
    """pandas-compatible NA literals → SQL NULL (text is compared as is)."""
    col = _c(c)
    return F.when(col.isin(list(na_values)), F.lit(None).cast("string")).otherwise(col)
