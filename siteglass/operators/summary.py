"""Totals, grouped capacity, leaders, option lists and short ranked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions.cleaning import not_nan
from siteglass.functions.columns import column_or_null, present
from siteglass.functions.text import amount_text, day_text
from siteglass.functions.totals import BEYOND, EXACT, partial_sums, summed, total
from siteglass.operators.filters import is_offshore

PREVIEW_COLUMNS = (
    "site_name",
    "operator",
    "technology",
    "capacity_mw",
    "status",
    "region",
    "county",
    "planning_authority",
    "score",
)
# Up to this many leading groups are sent to every task.
_BROADCAST_ROWS = 10_000

MAJOR_COLUMNS = ("site_name", "technology", "capacity_mw", "region", "status", "score")


def _latest(df: DataFrame) -> Column:
    return F.max(column_or_null(df, "last_updated", "date"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Record count and latest update of the whole register."""
    totals = df.agg(F.count(F.lit(1)).alias("records"), _latest(df).alias("latest_update"))
    return totals.withColumn("latest_update_text", day_text(F.col("latest_update")))


def kpis(df: DataFrame) -> DataFrame:
    """Headline figures in one pass, raw and as display text."""
    totals = df.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count("capacity_mw").alias("_measured"),
        *partial_sums(df, "capacity_mw"),
        _latest(df).alias("latest_update"),
    )
    return _with_kpi_texts(totals)


def group_kpis(groups: DataFrame) -> DataFrame:
    """The same figures as ``kpis`` from what ``capacity_groups`` returns."""
    totals = groups.agg(
        F.coalesce(F.sum("projects"), F.lit(0)).alias("projects"),
        F.coalesce(F.sum("measured"), F.lit(0)).alias("_measured"),
        *partial_sums(groups, "capacity_mw"),
        F.max("last_updated").alias("latest_update"),
    )
    return _with_kpi_texts(totals)


def _with_kpi_texts(totals: DataFrame) -> DataFrame:
    """Total and mean from the exact sums, and display texts. Texts are made from figures rounded to a watt."""
    figures = totals.select(
        "projects",
        F.coalesce(total("capacity_mw"), F.lit(0.0)).alias("total_capacity_mw"),
        F.try_divide(total("capacity_mw"), "_measured").alias("average_capacity_mw"),
        "latest_update",
    )
    return figures.withColumns(
        {
            "total_capacity_text": amount_text(F.round("total_capacity_mw", 6), 0, after=" MW"),
            "average_capacity_text": amount_text(F.round("average_capacity_mw", 6), 1, after=" MW"),
            "latest_update_text": day_text(F.col("latest_update")),
        }
    )


def capacity_groups(df: DataFrame) -> DataFrame:
    """Capacity, counts and latest update by technology, status and region at once.

    Small enough to persist. ``group_kpis``, ``capacity_by``, ``leading_groups`` and
    ``capacity_matrix`` take it in place of the projects: a report then reads the
    register once. It takes its own result as well, so groups of several parts of a
    register combine; the two sums behind ``capacity_mw`` stay with it for that.
    """
    if "measured" in df.columns:
        counts = [F.sum(name).alias(name) for name in ("projects", "measured")]
    else:
        counts = [F.count(F.lit(1)).alias("projects"), F.count("capacity_mw").alias("measured")]
    groups = df.groupBy("technology", "status", "region").agg(
        *partial_sums(df, "capacity_mw"), *counts, _latest(df).alias("last_updated")
    )
    return groups.withColumn("capacity_mw", total("capacity_mw"))


def capacity_by(
    df: DataFrame, group_col: str, value_col: str = "capacity_mw", n: int = 10
) -> DataFrame:
    """The ``n`` groups with the largest sums; rows without a group are left out."""
    groups = df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(*partial_sums(df, value_col))
    return summed(groups, value_col).orderBy(F.desc(value_col), F.asc(group_col)).limit(n)


def leading_groups(df: DataFrame) -> DataFrame:
    """The technology and the region with most capacity, as (facet, value, capacity_mw).

    One scan feeds both; a tie goes to the smaller name.
    """
    figures = [name for name in ("capacity_mw", "capacity_mw" + EXACT, "capacity_mw" + BEYOND) if name in df.columns]
    pairs = [
        F.struct(F.lit(name).alias("facet"), F.col(name).alias("value"), *figures)
        for name in ("technology", "region")
    ]
    rows = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    totals = summed(rows.groupBy("facet", "value").agg(*partial_sums(rows, "capacity_mw")), "capacity_mw")
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("capacity_mw"), F.asc("value")))
    return totals.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def _largest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with most capacity; ties go to the lower ``ref_id``.

    A first look at the capacity column alone finds the smallest capacity that can
    qualify. As a condition on the second read it lets Parquet skip the row groups
    below it, so the wide columns are read for few rows only.
    """
    floor = df.select("capacity_mw").orderBy(F.desc("capacity_mw")).limit(n).agg(F.min("capacity_mw"))
    wanted = df.where(F.col("capacity_mw") >= floor.scalar())
    return wanted.orderBy(F.desc("capacity_mw"), F.asc("ref_id")).limit(n)


def largest_project(df: DataFrame) -> DataFrame:
    """The project with most capacity, the figure also as display text."""
    text = amount_text(F.col("capacity_mw"), 0, after=" MW").alias("capacity_text")
    return _largest(df, 1).select("ref_id", "site_name", "capacity_mw", text)


def top_share(df: DataFrame, n: int = 10) -> DataFrame:
    """Share of the ``n`` largest projects in total capacity, in percent.

    Two reads of one column, each with partial results only: no shuffle of rows.
    """
    largest = df.select("capacity_mw").orderBy(F.desc("capacity_mw")).limit(n)

    def whole(rows: DataFrame) -> DataFrame:
        return rows.agg(*partial_sums(rows, "capacity_mw")).select(F.coalesce(total("capacity_mw"), F.lit(0.0)).alias("total_capacity_mw"))

    share = F.coalesce(F.try_divide("top_capacity_mw", "total_capacity_mw") * 100, F.lit(0.0))
    return (
        whole(df).select(whole(largest).scalar().alias("top_capacity_mw"), "total_capacity_mw")
        .withColumn("share_percent", not_nan(share))
        .withColumn("share_text", amount_text(F.round("share_percent", 6), 1, after="%"))
    )


def capacity_matrix(df: DataFrame, top: int = 6) -> DataFrame:
    """Capacity by technology and status within the ``top`` technologies.

    A technology's rank counts rows without a status too; the table leaves them out.
    """
    cells = df.where(F.col("technology").isNotNull()).groupBy("technology", "status").agg(*partial_sums(df, "capacity_mw"))
    leaders = capacity_by(cells, "technology", n=top).select("technology")
    # A condition on status alone would move below the aggregate and split the two
    # uses of ``cells``; tied to the sums it stays above, and Spark aggregates once.
    held = F.col("capacity_mw" + EXACT).isNotNull() | F.col("capacity_mw" + BEYOND).isNotNull()
    has_status = F.when(held, F.col("status")).isNotNull()
    if top <= _BROADCAST_ROWS:
        leaders = F.broadcast(leaders)
    return summed(cells.join(leaders, "technology", "left_semi").where(has_status), "capacity_mw")


def facets(df: DataFrame, columns: list[str] | dict[str, Column]) -> DataFrame:
    """Sorted distinct values per facet, as (facet, value), all in one scan.

    ``columns`` names columns, or maps facet names to expressions; a facet over some
    rows only is an expression that is NULL elsewhere.
    """
    if not isinstance(columns, dict):
        columns = {name: F.col(name) for name in columns}
    pairs = [F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in columns.items()]
    return (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("facet", "value")
    )


FACET_COLUMNS = ("technology", "status", "region")


def filter_choices(df: DataFrame) -> DataFrame:
    """Sorted choices as (facet, value): technologies, statuses, regions, names, names of offshore projects.

    Every record gives one row to either of two aggregates, which combine on the map side:
    the few combinations of technology, status and region, and the names.
    """
    combined = df.select(*FACET_COLUMNS).distinct()
    pairs = [F.struct(F.lit(name).alias("facet"), F.col(name).alias("value")) for name in FACET_COLUMNS]
    few = combined.select(F.inline(F.array(*pairs))).distinct()
    names = df.groupBy("site_name").agg(F.max(is_offshore()).alias("offshore"))
    facet = F.array(F.lit("site_name"), F.when(F.col("offshore"), F.lit("offshore_site_name")))
    many = names.select(F.explode(F.array_compact(facet)).alias("facet"), F.col("site_name").alias("value"))
    return few.union(many).where(F.col("value").isNotNull()).orderBy("facet", "value")


def preview(df: DataFrame, n: int = 250) -> DataFrame:
    """The first ``n`` rows in register order, in the columns a reader wants.

    Like ``_largest``, it looks at one narrow column first.
    """
    last = df.select("ref_id").orderBy("ref_id").limit(n).agg(F.max("ref_id"))
    wanted = df.where(F.col("ref_id") <= last.scalar())
    return wanted.orderBy("ref_id").limit(n).select(*present(df, PREVIEW_COLUMNS))


def major_projects(df: DataFrame, n: int = 10) -> DataFrame:
    return _largest(df, n).select(*MAJOR_COLUMNS)
