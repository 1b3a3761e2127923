"""Small registers for tests."""

from __future__ import annotations

RAW_COLUMNS = (
    "ref_id site_name operator technology capacity_raw status region county country planning_authority "
    "planning_ref planning_submitted planning_granted operational_date x_raw y_raw last_updated_raw"
).split()
RAW_SCHEMA = ", ".join(f"{name} {'bigint' if name == 'ref_id' else 'string'}" for name in RAW_COLUMNS)

FILLED = {"operator": "Op", "region": "R", "county": "C", "planning_authority": "PA", "planning_ref": "REF/1"}


def raw_row(ref_id: int, **cells) -> tuple:
    cells["ref_id"] = ref_id
    return tuple(cells.get(name) for name in RAW_COLUMNS)


def filled(count: int) -> dict:
    """The first ``count`` completeness fields."""
    return dict(list(FILLED.items())[:count])


def raw_frame(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


PROJECT_SCHEMA = (
    "ref_id bigint, site_name string, technology string, capacity_mw double, region string, status string, score int"
)
