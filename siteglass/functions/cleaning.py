"""Cell-level cleaning. A bad cell becomes NULL, never NaN and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteglass.schema import MISSING_TOKENS

# What pandas reads as a number. The guard matters because Spark's own cast also
# takes "5d", "NaN" and hexadecimal floats.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"

# Any character that is not white space, in Unicode terms (so U+00A0 is blank).
VISIBLE_PATTERN = r"(?U)[^\s\x1C-\x1F]"


_MISSING_LIST = ", ".join(f"'{token}'" for token in MISSING_TOKENS)


def missing_to_null(name: str) -> Column:
    """The named column with every text that means "missing" turned into NULL."""
    return F.expr(f"CASE WHEN `{name}` NOT IN ({_MISSING_LIST}) THEN `{name}` END")


def to_number(cell: Column) -> Column:
    return F.when(cell.rlike(NUMBER_PATTERN), cell.try_cast("double"))


def to_day(cell: Column) -> Column:
    """Day-first date, strictly ``d/M/yyyy``."""
    return F.try_to_timestamp(cell, F.lit("d/M/yyyy")).cast("date")


def is_filled(cell: Column) -> Column:
    """True when the cell holds any visible character; false for NULL.

    Most cells begin with a plain visible character; only the others need the pattern.
    """
    begins_visible = F.ascii(cell).between(33, 126)
    return F.coalesce(F.when(begins_visible, F.lit(True)).otherwise(cell.rlike(VISIBLE_PATTERN)), F.lit(False))


def finite(value: Column) -> Column:
    """The value where it is an ordinary number, else NULL."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def not_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
