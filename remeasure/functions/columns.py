"""Null- and NaN-safe column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that TRIM alone would leave at the ends of a label.
_EDGE_BLANKS = r"^\s+|\s+$"


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite(c: Column) -> Column:
    """``c`` where it is finite, else null."""
    return F.when(is_finite(c), c)


def is_reading(c: Column) -> Column:
    """True unless null or NaN; infinite values are readings."""
    return c.isNotNull() & ~F.isnan(c)


def clean_label(c: Column) -> Column:
    """Trimmed upper-case text; null stays null, blank becomes the empty string."""
    return F.upper(F.regexp_replace(c.cast("string"), _EDGE_BLANKS, ""))


def clean_or_unknown(c: Column) -> Column:
    """Trimmed upper-case text, with UNKNOWN for null, blank and NAN."""
    label = F.coalesce(clean_label(c), F.lit(""))
    return F.when(label.isin("", "NAN"), F.lit("UNKNOWN")).otherwise(label)


def clean_night(c: Column) -> Column:
    """A night as yyyymmdd text from 20210514, 2021-05-14, ' 20210514' or '20210514.0'; else null."""
    digits = F.regexp_extract(F.regexp_replace(c.cast("string"), r"[\s-]", ""), r"^(\d{8})(\.0*)?$", 1)
    return F.when(digits != "", digits)


def clean_pair_label(c: Column) -> Column:
    """``A / B`` in upper case with its parts in order, however it was spelled; null for blank or one-part labels.

    The pair is unordered, so DARK / BACKUP and BACKUP/DARK are one label.
    """
    parts = F.transform(F.split(clean_label(c), "/"), lambda p: F.regexp_replace(p, _EDGE_BLANKS, ""))
    usable = (F.size(parts) == 2) & ~F.array_contains(parts, "")
    return F.when(usable, F.array_join(F.sort_array(parts), " / "))
