"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Stripped, lower case, inner white space as single spaces."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def lookup(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """The value for c in a constant map, null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), c)


def to_number(c: Column) -> Column:
    """Plain decimal or exponent notation as a double, anything else null (a cast alone would take '1d' and 'nan')."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c).try_cast("double"))


def cents(c: Column) -> Column:
    """Rounded to two decimals, half to even on the scaled value."""
    return F.rint(c * 100) / 100
