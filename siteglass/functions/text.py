"""Text renderings: file names, dates, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "N/A"


def safe_filename(name: Column) -> Column:
    return F.translate(name, "/\\: ", "---_")


def or_not_available(cell: Column) -> Column:
    return F.coalesce(cell, F.lit(NOT_AVAILABLE))


def day_text(day: Column) -> Column:
    """``05 Mar 2024``, or N/A."""
    return or_not_available(F.date_format(day, "dd MMM yyyy"))


def amount_text(value: Column, digits: int, before: str = "", after: str = "") -> Column:
    """Grouped decimal text such as ``£1,234.5m``."""
    return F.concat(F.lit(before), F.format_number(value, digits), F.lit(after))


def plain_number(value: Column) -> Column:
    """Shortest text that reads back as the same double: positional from 1e-4 up to 1e16, else with an exponent.

    As in ``12345678.0``, ``0.0005``, ``1e-05``, ``2.5e+16``, ``inf``, ``nan``. Spark's own text goes over
    to an exponent earlier, and on some Java versions isn't the shortest. Where it is plain and has at most 15
    digits it is the shortest, but for zeros at its end; other numbers are spelt digit by digit, in a
    function of their own that keeps the generated code of the usual ones short.
    """
    text = value.cast("string")
    plain = F.abs(value).between(1e-3, 9_999_999.0) & (F.length(text) <= 16) & (text.endswith(".0") | ~text.endswith("0"))
    return F.when(plain, text).otherwise(F.get(F.transform(F.array(value), _spelt_number), F.lit(0)))


def _spelt_number(value: Column) -> Column:
    size = F.abs(value)
    # 17 digits always suffice; fewer do if they read back as the same number.
    rounded = [F.format_string(f"%.{digits - 1}e", size) for digits in (15, 16, 17)]
    text = F.coalesce(*[F.when(r.try_cast("double") == size, r) for r in rounded[:2]], rounded[2])
    digits = F.regexp_replace(F.replace(F.substring_index(text, "e", 1), F.lit(".")), "0+$", "")
    power = F.substring_index(text, "e", -1).try_cast("int")
    whole = F.rpad(F.left(digits, power + 1), power + 1, F.lit("0"))
    rest = F.substr(digits, power + 2)
    positional = F.when(
        power >= 0, F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    fraction = F.substr(digits, F.lit(2))
    exponent = F.abs(power).cast("string")
    scientific = F.concat(
        F.left(digits, F.lit(1)),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(exponent) < 2, F.concat(F.lit("0"), exponent)).otherwise(exponent),
    )
    unsigned = (
        F.when(size == float("inf"), F.lit("inf"))
        .when(size == 0, F.lit("0.0"))
        .when((power >= -4) & (power < 16), positional)
        .otherwise(scientific)
    )
    sign = F.when(value.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(value), F.lit("nan")).otherwise(F.concat(sign, unsigned))
