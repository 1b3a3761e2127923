"""Sums that come out the same in whatever order rows and partial sums meet.

A sum of doubles depends on the order of its additions in the last bits, so equal groups
may differ and swap places. Here numbers are added as they are written: as decimals with 12 places, exactly.
Usual ones, of up to six places and below 1e9, are added as whole millionths in two halves that can't overflow,
which costs little more than doubles do. Numbers of 1e17 and more, infinite ones included, go into a plain sum of their own.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DECIMAL = "decimal(38,12)"
# Two of these add up to the one above, no place lost.
_PART = "decimal(37,12)"
# Up to here 10^9 numbers can be added before a decimal overflows.
_WRITTEN = 1e17
# Numbers whose millionths a double holds exactly, and the bits of the lower half of these.
_USUAL, _HALF = 1e9, 20
# What a pre-aggregate keeps beside a total, so that totals of totals are exact too.
EXACT, BEYOND = "_exact", "_beyond"


def _is_beyond(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) >= _WRITTEN)


def partial_sums(df: DataFrame, value: str) -> list[Column]:
    """Aggregates ``value``_exact and ``value``_beyond; ``df`` holds the values or, from before, these two."""
    if value + EXACT in df.columns:
        return [F.sum(value + EXACT).cast(_DECIMAL).alias(value + EXACT), F.sum(value + BEYOND).alias(value + BEYOND)]
    number = F.col(value).cast("double")
    millionths = F.rint(number * 1e6)
    usual = (F.abs(number) < _USUAL) & (millionths / 1e6 == number)
    whole = F.when(usual, millionths).cast("bigint")
    high, low = F.sum(F.shiftright(whole, _HALF)), F.sum(whole.bitwiseAND(F.lit((1 << _HALF) - 1).cast("bigint")))
    added = (high.cast("decimal(20,0)") * F.lit(1 << _HALF) + low).cast("decimal(32,0)") * F.lit(Decimal("0.000001"))
    other = F.sum(F.when(~usual & ~_is_beyond(number), number).cast(_DECIMAL)).cast(_PART)
    added = added.cast(_PART)
    exact = F.coalesce(added + other, added, other).cast(_DECIMAL)
    return [exact.alias(value + EXACT), F.sum(F.when(_is_beyond(number), number)).alias(value + BEYOND)]


def total(value: str) -> Column:
    """The double that two aggregates of :func:`partial_sums` stand for; NULL if there was no value."""
    exact, beyond = F.col(value + EXACT).cast("double"), F.col(value + BEYOND)
    return F.when(beyond.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + beyond)


def summed(aggregated: DataFrame, value: str) -> DataFrame:
    """``aggregated`` with the total in ``value`` in place of the two sums."""
    keys = [F.col(f"`{name}`") for name in aggregated.columns if name not in (value + EXACT, value + BEYOND)]
    return aggregated.select(*keys, total(value).alias(value))
