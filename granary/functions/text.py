"""Text rules: first and all matches, extraction, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.missing import ColumnOrName, as_col

# POSIX class names and their Unicode equivalents.
POSIX = {
    "[:alpha:]": r"\p{L}",
    "[:digit:]": r"\p{Nd}",
    "[:alnum:]": r"\p{L}\p{Nd}",
    "[:upper:]": r"\p{Lu}",
    "[:lower:]": r"\p{Ll}",
    "[:space:]": r"\s",
    "[:punct:]": r"\p{P}",
}

WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


def unicode_classes(pattern: str) -> str:
    """Java reads ``[:alpha:]`` as a plain set of letters; spell the class out."""
    for name, spelled in POSIX.items():
        pattern = pattern.replace(name, spelled)
    return pattern


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(value: ColumnOrName, pattern: str, replacement: str) -> Column:
    """Replace the first match only."""
    whole = rf"\A(?<kept>[\s\S]*?)(?:{unicode_classes(pattern)})(?<rest>[\s\S]*)\z"
    return F.regexp_replace(
        as_col(value), F.lit(whole), F.lit("${kept}" + _literal(replacement) + "${rest}")
    )


def replace_all(value: ColumnOrName, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(
        as_col(value), F.lit(unicode_classes(pattern)), F.lit(_literal(replacement))
    )


def detect(value: ColumnOrName, pattern: str) -> Column:
    return as_col(value).rlike(unicode_classes(pattern))


def extract(value: ColumnOrName, pattern: str) -> Column:
    """First match, NULL if there is none."""
    return F.regexp_substr(as_col(value), F.lit(unicode_classes(pattern)))


def right(value: ColumnOrName, n: int) -> Column:
    return F.right(as_col(value), F.lit(n))


def title(value: ColumnOrName) -> Column:
    return F.initcap(as_col(value))


def words(value: ColumnOrName) -> Column:
    """Lower-case words of a text as an array; punctuation is dropped."""
    return F.regexp_extract_all(F.lower(as_col(value)), F.lit(WORD), F.lit(0))
