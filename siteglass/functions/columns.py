"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_or_null(df: DataFrame, name: str, type_: str = "string") -> Column:
    """``df[name]``, or a typed NULL when the register has no such column."""
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def present(df: DataFrame, names: tuple[str, ...] | list[str]) -> list[str]:
    """Those of ``names`` that ``df`` has, in the order given."""
    return [name for name in names if name in df.columns]
