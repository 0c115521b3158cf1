"""Question-number expressions (J1-J6, J8, J10, D11) as Column -> Column.

Regexes are written ASCII-only (``[0-9]``, ``[a-z]``) so Java, RE2 and the
oracle agree; rewrites are unanchored and replace every match, in the order
given, like the transcription cleaner they stand in for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WHITESPACE, py_strip

# Ordered rewrites that bring a transcribed number to d(l)(r) form
# (pattern, replacement); lower-case letters and roman numerals i/v/x only.
FIX_REWRITES = [
    ("([0-9]+)\\.([a-z]+)\\.([ivx]+)", "$1($2)($3)"),
    ("([0-9]+)\\.([a-z]+)", "$1($2)"),
    ("([0-9]+)\\.\\(([a-z])\\)\\.([ivx]+)", "$1($2)($3)"),
    ("\\.\\(", "("),
]

# Standardisation rewrites applied after FIX_REWRITES.
STANDARD_REWRITES = [
    ("([0-9]+)([a-z])", "$1($2)"),
]

# Fixed value: main number plus first bracket group (rest of the text dropped).
SUB_NUMBER = ("(?s)^([^(]*)\\(([^()]*).*$", "$1($2)")

# Fixed value: one trailing roman-numeral part, bracketed or bare, with its separator.
BASE_SUFFIX = "[" + PY_WHITESPACE + "_]*(\\([ivx]+\\)|[ivx]+)$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fix_question_number(c: Column | str, null_as: str | None = None) -> Column:
    """J1. ``null_as='nan'`` reproduces the reference's text for a null number."""
    c = _c(c)
    if null_as is not None:
        c = F.coalesce(c, F.lit(null_as))
    for pat, rep in FIX_REWRITES:
        c = F.regexp_replace(c, pat, rep)
    return py_strip(F.regexp_replace(c, " ", ""))


def standardize_question_number(c: Column | str) -> Column:
    """J2."""
    c = _c(c)
    for pat, rep in STANDARD_REWRITES:
        c = F.regexp_replace(c, pat, rep)
    return c


def normalize_question_number(c: Column | str, null_as: str | None = None) -> Column:
    """J1 then J2."""
    return standardize_question_number(fix_question_number(c, null_as))


def base_question_number(c: Column | str) -> Column:
    """Drop one trailing roman part (``12(a)(ii)`` -> ``12(a)``, ``v`` -> empty)."""
    return py_strip(F.regexp_replace(py_strip(_c(c)), BASE_SUFFIX, ""))


def main_question_number(c: Column | str) -> Column:
    """Text before the first ``(``."""
    return F.substring_index(_c(c), "(", 1)


def sub_question_number(c: Column | str) -> Column:
    """Main number plus the first bracket group; an unclosed bracket is closed."""
    # One regex with a single reference to ``c``: text without "(" does not
    # match and is returned unchanged, so the (possibly large) input expression
    # is not duplicated when Catalyst inlines it.
    return F.regexp_replace(_c(c), SUB_NUMBER[0], SUB_NUMBER[1])


def integer_text(c: Column | str) -> Column:
    """``12.0`` -> ``12``, ``007`` -> ``7``; anything else unchanged."""
    c = _c(c)
    digits = F.regexp_replace(F.regexp_replace(c, "\\.0+$", ""), "^0+([0-9])", "$1")
    return F.when(c.rlike("^[0-9]+(\\.0+)?$"), digits).otherwise(c)


def is_digits(c: Column | str) -> Column:
    """ASCII digits only, at least one."""
    return _c(c).rlike("^[0-9]+$")


def delimit_cell(c: Column | str) -> Column:
    """J8 step 1: runs of whitespace . _ ( ) become one space; then strip."""
    return py_strip(F.regexp_replace(py_strip(_c(c)), "[" + PY_WHITESPACE + "._()]+", " "))


def letter_parts(c: Column | str) -> Column:
    """J8 step 2: each ASCII letter run in its own brackets, concatenated."""
    runs = F.regexp_extract_all(_c(c), F.lit("([A-Za-z]+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.lit("("), x, F.lit(")"))), "")


def has_letters(c: Column | str) -> Column:
    return _c(c).rlike("[A-Za-z]")


def leading_number(c: Column | str) -> Column:
    """Leading ASCII digits or empty."""
    return F.regexp_extract(_c(c), "^([0-9]+)", 1)
