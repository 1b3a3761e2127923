"""Row selection: search, exact choices, map points, first record per name."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions.columns import column_or_null, present
from siteglass.schema import SEARCH_COLUMNS

ALL = "All"
_REGEX_SIGNS = set(r".^$*+?{}[]\|()")


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose searchable fields, joined by one space, match ``query``.

    The query is a regular expression, compared in lower case and not trimmed; a
    blank one keeps every row. A match may run across two neighbouring fields.
    Lower-casing also turns a class such as ``\\S`` into ``\\s``.
    """
    if not query.strip():
        return df
    wanted = query.lower()
    text = searchable_text(df)
    if _REGEX_SIGNS.isdisjoint(wanted):
        return df.where(text.contains(wanted))
    # (?d): only a newline ends a line, as in the usual non-Java dialects.
    pattern = "(?d)" + wanted
    _check_pattern(df, pattern)
    return df.where(text.rlike(pattern))


def searchable_text(df: DataFrame) -> Column:
    """What a search looks at: the searchable fields in lower case, joined by one space."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(name), F.lit("")) for name in present(df, SEARCH_COLUMNS)]))


def required_texts(query: str) -> list[str]:
    """Texts that every match of a query holds, in lower case; none if that can't be told.

    Of a pattern, these are the plain stretches outside groups and classes that no quantifier makes
    optional. A pattern with alternatives, flags or escapes that stand for letters has none.
    """
    wanted = query.lower()
    if _REGEX_SIGNS.isdisjoint(wanted):
        return [wanted]
    found, run, at = [], "", 0

    def end() -> None:
        nonlocal run
        if run:
            found.append(run)
        run = ""

    while at < len(wanted):
        sign = wanted[at]
        if sign == "|" or wanted.startswith("(?", at) and wanted[at + 2 : at + 3] not in set(":=!<>"):
            return []
        if sign == "\\":
            escaped = wanted[at + 1 : at + 2]
            if escaped in set("bdsw"):
                end()
            elif not escaped or escaped.isalnum():
                return []
            else:
                run += escaped
            at += 1
        elif sign in "([":
            end()
            at = _closing(wanted, at)
        elif sign in "?*{":
            run = run[:-1]
            end()
            if sign == "{":
                at = max(at, wanted.find("}", at))
        elif sign in ".^$+":
            end()
        else:
            run += sign
        at += 1
    end()
    return found


def _closing(pattern: str, at: int) -> int:
    """Where the group or class that opens at ``at`` closes; the end of the pattern if it doesn't."""
    closes = [")" if pattern[at] == "(" else "]"]
    while closes and (at := at + 1) < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 1
        elif sign == closes[-1]:
            closes.pop()
        elif sign == "[" or sign == "(" and closes[-1] == ")":
            closes.append(")" if sign == "(" else "]")
    return at


def _check_pattern(df: DataFrame, pattern: str) -> None:
    """Report a bad pattern now, not in the middle of a long job (needs no data)."""
    try:
        df.sparkSession.sql("SELECT rlike('', :pattern)", args={"pattern": pattern}).collect()
    except PySparkException as error:
        raise ValueError(f"not a valid search pattern: {pattern[4:]!r}") from error


def apply_filters(
    df: DataFrame,
    technology: str = ALL,
    status: str = ALL,
    region: str = ALL,
    query: str = "",
) -> DataFrame:
    """All filters at once; ``"All"`` switches a choice off."""
    kept = search(df, query)
    for name, choice in (("technology", technology), ("status", status), ("region", region)):
        if choice != ALL:
            kept = kept.where(F.col(name) == F.lit(choice))
    return kept


def is_offshore() -> Column:
    return F.lower(F.col("technology")).contains("wind offshore")


def offshore_projects(df: DataFrame) -> DataFrame:
    return df.where(is_offshore())


def map_points(df: DataFrame) -> DataFrame:
    """One point per located project, with the fields a map shows."""
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "ref_id",
        "site_name",
        "lat",
        "lon",
        "capacity_mw",
        "technology",
        column_or_null(df, "region").alias("region"),
        column_or_null(df, "status").alias("status"),
        "score",
    )


def first_by_name(df: DataFrame) -> DataFrame:
    """The first record, in register order, of every named site.

    ``row_number() = 1`` lets Spark drop all but one record per name before the
    shuffle, so a name carried by very many records does not swamp a task.
    """
    order = Window.partitionBy("site_name").orderBy("ref_id")
    return (
        df.where(F.col("site_name").isNotNull())
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") == 1)
        .drop("_place")
    )
