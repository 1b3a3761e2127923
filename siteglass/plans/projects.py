"""From raw register rows to screened projects. Every step is row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import cleaning, geodesy, scoring
from siteglass.functions.columns import column_or_null, present
from siteglass.schema import COMPLETENESS_COLUMNS, TYPED_COLUMNS

_NUMBER_SOURCES = {"capacity_raw": "capacity_mw", "x_raw": "x", "y_raw": "y"}


def clean(raw: DataFrame) -> DataFrame:
    """Typed projects: numbers and date parsed, rows without a capacity dropped."""
    columns = []
    for name in raw.columns:
        if name in TYPED_COLUMNS:
            columns.append(F.col(f"`{name}`"))
        elif name in _NUMBER_SOURCES:
            columns.append(cleaning.to_number(F.col(name)).alias(_NUMBER_SOURCES[name]))
        else:
            columns.append(cleaning.missing_to_null(name).alias(name))
    if "last_updated_raw" in raw.columns:
        columns.append(cleaning.to_day(F.col("last_updated_raw")).alias("last_updated"))
    return raw.select(*columns).where(F.col("capacity_mw").isNotNull())


def with_lat_lon(df: DataFrame) -> DataFrame:
    """Add WGS84 ``lon`` and ``lat``; rows without both coordinates keep NULLs."""
    return geodesy.add_lon_lat(df)


def with_score(df: DataFrame, components: bool = False) -> DataFrame:
    """Add the screening ``score`` and, if asked, its four parts."""
    # Lowered once, in a step of their own, and not once per word looked for.
    lowered = {"_" + name: F.lower(column_or_null(df, name)) for name in ("status", "technology")}
    parts = {
        "capacity_points": scoring.capacity_points(F.col("capacity_mw")),
        "status_points": scoring.status_points(F.col("_status")),
        "technology_points": scoring.technology_points(F.col("_technology")),
        "completeness_points": scoring.completeness_points(
            [F.col(name) for name in present(df, COMPLETENESS_COLUMNS)]
        ),
    }
    scored = df.withColumns(lowered)
    if components:
        scored = scored.withColumns(parts)
        parts = {name: F.col(name) for name in parts}
    return scored.withColumn("score", scoring.total_points(*parts.values())).drop(*lowered)


def prepare(raw: DataFrame) -> DataFrame:
    """Clean, located and scored projects. Unused columns cost nothing downstream."""
    return with_score(with_lat_lon(clean(raw)))
