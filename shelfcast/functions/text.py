"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze_ends(col: Column) -> Column:
    """Strip every kind of white space at both ends (``trim`` alone keeps tabs and line breaks)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def capitalise(col: Column) -> Column:
    """First letter upper, all others lower, as one word ("hOME goods" gives "Home goods")."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def money(col: Column) -> Column:
    """Digits and dots of a mixed price text as a double; no digit, or more than one dot, gives null."""
    text = col.cast("string")
    digits = F.regexp_replace(text, r"[^0-9.]", "")
    return F.when(text.rlike("[0-9]"), digits.try_cast("double"))


def number(col: Column) -> Column:
    """Lenient number parse; anything unparsable becomes null."""
    return squeeze_ends(col.cast("string")).try_cast("double")


def first_word(col: Column) -> Column:
    return F.split(squeeze_ends(col), r"\s+").getItem(0)


def last_word(col: Column) -> Column:
    return F.element_at(F.split(squeeze_ends(col), r"\s+"), -1)
