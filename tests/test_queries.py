"""Every registered query against its SQL, and what the plans look like."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import siteglass as sg
from siteglass.plans.checks import ORACLE_SQL
from siteglass.plans.queries import ON_LOCATED, ON_PROJECTS, QUERIES, located
from siteglass.sources.register import read_projects, write_projects
from tests.compare import duck, duck_table, spark_table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, database, name):
    found = spark_table(entry_points.queries()[name](spark, SMALL))
    assert found == duck_table(database, entry_points.oracle_sql()[name])


def test_every_query_of_the_register_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= entry_points.queries().keys() and ORACLE_SQL.keys() <= entry_points.oracle_sql().keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed") / "projects")
    write_projects(located(spark, SMALL), path)
    return read_projects(spark, path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ON_PROJECTS.keys() | ON_LOCATED.keys()))
def test_plans_stay_native(landed, name):
    plan = plan_of((ON_PROJECTS | ON_LOCATED)[name](landed))
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "MapInArrow" not in plan or name == "comparables"


@pytest.mark.parametrize("name", ["screening_score", "filter_combined", "offshore_model", "offshore_sensitivity", "map_points"])
def test_row_local_queries_do_not_shuffle(landed, name):
    assert "Exchange" not in plan_of((ON_PROJECTS | ON_LOCATED)[name](landed))


@pytest.mark.parametrize("name", ["major_projects", "preview_projects", "largest_project", "capacity_by_technology"])
def test_short_lists_do_not_sort_everything(landed, name):
    assert "TakeOrderedAndProject" in plan_of(ON_PROJECTS[name](landed))


def test_rows_are_thinned_before_the_shuffle(landed):
    for name in ("first_by_name", "project_briefs"):
        plan = plan_of(ON_PROJECTS[name](landed))
        assert "row_number(), 1, Partial" in plan or "row_number(), 5, Partial" in plan


def test_one_project_is_looked_up_at_the_scan(landed):
    plan = plan_of(ON_PROJECTS["comparables_of_one"](landed))
    assert "EqualTo(technology," in plan and "GreaterThanOrEqual(capacity_mw," in plan and "LessThanOrEqual(capacity_mw," in plan
    assert "TakeOrderedAndProject" in plan and "ExistingRDD" not in plan


def test_facets_give_a_record_one_row_per_aggregate(landed):
    plan = plan_of(ON_PROJECTS["facet_options"](landed))
    below = plan[plan.index("HashAggregate(keys=[technology") :]
    assert "Generate" not in below[: below.index("FileScan")]


def test_choices_reach_the_scan(landed):
    plan = plan_of(ON_PROJECTS["filter_combined"](landed))
    for part in ("EqualTo(technology,Solar Photovoltaics)", "EqualTo(status,Planning Granted)", "EqualTo(region,EUROPE)"):
        assert part in plan


def test_sums_agree(landed):
    """Groups never hold more than the total, and scores stay in their range."""
    total = sg.kpis(landed).collect()[0].total_capacity_mw
    for column in ("technology", "region", "status"):
        groups = sg.capacity_by(landed, column, n=10_000).collect()
        missing = landed.where(F.col(column).isNull()).agg(F.sum("capacity_mw")).collect()[0][0]
        assert sum(row.capacity_mw for row in groups) + missing == pytest.approx(total)
    low, high = landed.agg(F.min("score"), F.max("score")).collect()[0]
    assert 23 <= low <= high <= 100
