"""Screening of large energy-project registers as Spark DataFrame jobs.

Public functions take DataFrames and return lazy DataFrames, so calls compose and
Catalyst plans the whole chain at once. Some run jobs when called: ``comparables`` its
ordered pass, ``comparables_of`` and ``comparables_among`` the lookup of the chosen names, ``search_landed``
that of the files that may hold a match.
"""

from siteglass.operators.briefs import project_briefs, project_details, project_headlines
from siteglass.operators.comparables import comparables, comparables_among, comparables_of
from siteglass.operators.filters import (
    apply_filters,
    first_by_name,
    map_points,
    offshore_projects,
    search,
)
from siteglass.operators.offshore import (
    DEFAULT_SCENARIO,
    SENSITIVITY_GRID,
    Scenario,
    check_scenarios,
    offshore_model,
    offshore_sensitivity,
    offshore_texts,
    with_offshore_figures,
    with_scenarios,
)
from siteglass.operators.summary import (
    capacity_by,
    capacity_groups,
    capacity_matrix,
    dataset_summary,
    facets,
    filter_choices,
    group_kpis,
    kpis,
    largest_project,
    leading_groups,
    major_projects,
    preview,
    top_share,
)
from siteglass.plans.projects import clean, prepare, with_lat_lon, with_score
from siteglass.sources.register import read_projects, read_register, write_projects
from siteglass.sources.search_index import search_landed, write_search_index
from siteglass.sources.sinks import export_csv, read_briefs, read_export, write_briefs, write_register_csv
from siteglass.streaming.deliveries import deliveries, kept_groups, land_deliveries, read_landed

__all__ = [name for name in dir() if not name.startswith("_")]
