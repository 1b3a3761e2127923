"""Score, filters, summaries, offshore model and briefs on hand-worked rows."""

import datetime
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

import siteglass as sg
from siteglass.functions.text import plain_number
from tests.rows import PROJECT_SCHEMA, filled, raw_frame, raw_row

# capacity, status, technology, filled fields, expected score.
SCORES = [
    ("1000", "Operational", "Wind Offshore", 5, 100),
    ("999.9", "Under Construction", "Battery", 5, 86),
    ("500", "Awaiting Construction", "Pumped Storage", 4, 84),
    ("100", "PLANNING GRANTED", "Solar Photovoltaics", 3, 66),
    ("20", "Planning Submitted", "Wind Onshore", 2, 46),
    ("19.99", "Refused", "Biomass", 1, 25),
    (" 5 ", None, None, 0, 23),
    ("-3", "Operational", "Solar with Battery", 0, 58),
    ("0", "Operational", "Wind Offshore", 5, 70),
    ("inf", "Revised construction", "offshore WIND OFFSHORE", 0, 85),
]


def test_scores(spark):
    rows = [
        raw_row(i, capacity_raw=capacity, status=status, technology=technology, **filled(done))
        for i, (capacity, status, technology, done, _) in enumerate(SCORES)
    ]
    scored = sg.with_score(sg.clean(raw_frame(spark, rows)), components=True).orderBy("ref_id").collect()
    assert [row.score for row in scored] == [expected for *_, expected in SCORES]
    for row in scored:
        assert row.score == row.capacity_points + row.status_points + row.technology_points + row.completeness_points
        assert 23 <= row.score <= 100


def test_blank_fields_do_not_count(spark):
    rows = [raw_row(1, capacity_raw="1", operator="  ", region=" ", county="C", planning_ref="")]
    assert sg.with_score(sg.clean(raw_frame(spark, rows))).collect()[0].score == 5 + 8 + 10 + 2


@pytest.fixture(scope="module")
def register(spark):
    rows = [
        raw_row(0, site_name="Alpha", operator="North Power", technology="Wind Offshore", capacity_raw="100",
                status="Operational", region="East", county="Kent", last_updated_raw="01/02/2024"),
        raw_row(1, site_name="Beta", operator="South Power", technology="Battery", capacity_raw="50",
                status="Planning Granted", region="West", last_updated_raw="05/03/2024"),
        raw_row(2, site_name="Alpha", technology="Battery", capacity_raw="300", status="Refused", region="East"),
        raw_row(3, site_name=None, technology="wind offshore (floating)", capacity_raw="0", status=None, region=None),
        raw_row(4, site_name="Delta / x:y\\z", technology=None, capacity_raw="250", status="Operational", region="West"),
    ]
    return sg.prepare(raw_frame(spark, rows)).cache()


def ids(df):
    return sorted(row.ref_id for row in df.collect())


def test_search(register):
    assert ids(sg.search(register, "")) == ids(sg.search(register, "  ")) == [0, 1, 2, 3, 4]
    assert ids(sg.search(register, "ALPHA")) == [0, 2]
    assert ids(sg.search(register, "power battery")) == [1]  # across two fields
    assert ids(sg.search(register, "Power.*(Battery|Offshore)")) == [0, 1]
    assert ids(sg.search(register, "alpha  battery")) == [2]  # a missing field leaves its separators
    assert ids(sg.search(register, "delta / x:y")) == [4]
    assert ids(sg.search(register, r"x:y\\z")) == [4]
    assert ids(sg.search(register, r"^\S")) == [3]  # lower-cased to \s: only a missing name starts blank
    assert ids(sg.search(register, " kent ")) == [0]  # not trimmed
    with pytest.raises(ValueError, match="pattern"):
        sg.search(register, "(open")


def test_filters(register):
    assert ids(sg.apply_filters(register)) == [0, 1, 2, 3, 4]
    assert ids(sg.apply_filters(register, technology="Battery")) == [1, 2]
    assert ids(sg.apply_filters(register, status="Operational", region="West")) == [4]
    assert ids(sg.apply_filters(register, region="East", query="battery")) == [2]
    assert ids(sg.apply_filters(register, region="Nowhere")) == []
    assert ids(sg.offshore_projects(register)) == [0, 3]


def test_first_by_name(register):
    assert ids(sg.first_by_name(register)) == [0, 1, 4]


def test_summaries(register):
    assert tuple(sg.dataset_summary(register).collect()[0]) == (5, datetime.date(2024, 3, 5), "05 Mar 2024")
    kpis = sg.kpis(register).collect()[0]
    assert (kpis.projects, kpis.total_capacity_mw, kpis.average_capacity_mw) == (5, 700.0, 140.0)
    assert (kpis.total_capacity_text, kpis.average_capacity_text) == ("700 MW", "140.0 MW")
    assert [tuple(r) for r in sg.capacity_by(register, "technology", n=2).collect()] == [("Battery", 350.0), ("Wind Offshore", 100.0)]
    assert sorted(tuple(r) for r in sg.leading_groups(register).collect()) == [("region", "East", 400.0), ("technology", "Battery", 350.0)]
    assert tuple(sg.largest_project(register).collect()[0]) == (2, "Alpha", 300.0, "300 MW")
    share = sg.top_share(register, n=2).collect()[0]
    assert (share.top_capacity_mw, share.share_percent, share.share_text) == (550.0, 550 / 700 * 100, "78.6%")
    assert [r.capacity_mw for r in sg.major_projects(register, 3).collect()] == [300.0, 250.0, 100.0]
    assert [r.site_name for r in sg.preview(register, 2).collect()] == ["Alpha", "Beta"]


def test_ties_go_to_the_lower_key(spark):
    rows = [(i, f"n{i}", t, 10.0, r, "s", 1) for i, (t, r) in enumerate([("B", "y"), ("A", "x"), ("B", "x"), ("A", "y")])]
    df = spark.createDataFrame(rows, PROJECT_SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in sg.leading_groups(df).collect()) == [("region", "x", 20.0), ("technology", "A", 20.0)]
    assert sg.largest_project(df).collect()[0].ref_id == 0
    assert [r.site_name for r in sg.major_projects(df, 3).collect()] == ["n0", "n1", "n2"]
    assert [r.technology for r in sg.capacity_by(df, "technology", n=1).collect()] == ["A"]


def test_matrix_ranks_by_all_rows_but_shows_those_with_status(register):
    cells = sorted(tuple(r) for r in sg.capacity_matrix(register, top=2).collect())
    assert cells == [("Battery", "Planning Granted", 50.0), ("Battery", "Refused", 300.0), ("Wind Offshore", "Operational", 100.0)]


def test_matrix_reads_the_register_once(register, spark, tmp_path):
    sg.write_projects(register, str(tmp_path / "p"))
    matrix = sg.capacity_matrix(sg.read_projects(spark, str(tmp_path / "p")))
    matrix.collect()
    assert "ReusedExchange" in matrix._jdf.queryExecution().executedPlan().toString()


def test_grouped_operators_accept_the_pre_aggregate(register):
    groups = sg.capacity_groups(register)
    for operator in (lambda df: sg.capacity_by(df, "region", n=8), sg.leading_groups, sg.capacity_matrix):
        assert sorted(operator(groups).collect()) == sorted(operator(register).collect())
    assert sg.group_kpis(groups).collect() == sg.kpis(register).collect()
    assert sg.group_kpis(groups.where("false")).collect() == sg.kpis(register.where("false")).collect()


def test_empty_register(register):
    none = register.where("false")
    kpis = sg.kpis(none).collect()[0]
    assert (kpis.projects, kpis.total_capacity_mw, kpis.average_capacity_mw, kpis.latest_update_text) == (0, 0.0, None, "N/A")
    assert sg.top_share(none).collect()[0].share_percent == 0.0
    for df in (sg.leading_groups(none), sg.largest_project(none), sg.capacity_matrix(none), sg.preview(none),
               sg.major_projects(none), sg.map_points(none), sg.facets(none, ["region"])):
        assert df.collect() == []


def test_all_keys_missing(register):
    assert sg.leading_groups(register.where("technology IS NULL AND region = 'x'")).collect() == []
    only_region = sg.leading_groups(register.where("technology IS NULL")).collect()
    assert [tuple(r) for r in only_region] == [("region", "West", 250.0)]


def test_facets(register):
    found = [tuple(r) for r in sg.facets(register, ["technology", "region"]).collect()]
    assert found == [
        ("region", "East"), ("region", "West"),
        ("technology", "Battery"), ("technology", "Wind Offshore"), ("technology", "wind offshore (floating)"),
    ]


def test_offshore_defaults(register):
    row = sg.offshore_model(sg.offshore_projects(register)).where("ref_id = 0").collect()[0]
    assert row.annual_energy_mwh == pytest.approx(394_200)
    assert row.turbines == pytest.approx(6.666667, abs=1e-6)
    assert row.annual_revenue == pytest.approx(27_594_000)
    assert row.total_capex == pytest.approx(300_000_000)
    assert row.simple_payback == pytest.approx(10.871929, abs=1e-6)
    assert row.lifetime_revenue == pytest.approx(689_850_000)
    assert row.annual_carbon_t == pytest.approx(78_840)
    assert row.lifetime_carbon_t == pytest.approx(1_971_000)
    texts = sg.offshore_texts(sg.offshore_model(sg.offshore_projects(register))).where("ref_id = 0").collect()[0]
    assert texts.annual_energy_text == "394,200 MWh/year" and texts.turbines_text == "6.7"
    assert texts.total_capex_text == "£0.30bn" and texts.annual_revenue_text == "£27.6m/year"
    assert texts.simple_payback_text == "10.9 years" and texts.lifetime_carbon_text == "1,971,000 tonnes CO₂e"


def test_offshore_without_capacity_has_no_payback(register):
    row = sg.offshore_model(sg.offshore_projects(register)).where("ref_id = 3").collect()[0]
    assert (row.annual_energy_mwh, row.total_capex, row.simple_payback) == (0.0, 0.0, None)


def test_offshore_scenarios_and_sensitivity(register):
    dear = sg.Scenario(electricity_price=140.0)
    runs = sg.offshore_model(sg.offshore_projects(register), [sg.DEFAULT_SCENARIO, dear]).where("ref_id = 0")
    by_price = {row.electricity_price: row.simple_payback for row in runs.collect()}
    assert by_price[70.0] == pytest.approx(2 * by_price[140.0])
    grid = sg.offshore_sensitivity(sg.offshore_projects(register)).where("ref_id = 0").orderBy("capacity_factor").collect()
    assert [row.capacity_factor for row in grid] == list(sg.SENSITIVITY_GRID)
    assert grid[2].simple_payback == pytest.approx(10.871929, abs=1e-6)
    assert grid[0].annual_revenue_m == pytest.approx(100 * 0.35 * 8760 * 70 / 1e6)


def test_scenario_ranges(spark):
    good = (0.45, 15.0, 70.0, 3.0, 25, 0.2)
    rows = [good, (0.2, 5.0, 20.0, 1.0, 10, 0.0), (0.7, 25.0, 200.0, 8.0, 40, 0.6), (0.19, 15.0, 70.0, 3.0, 41, 0.2), (None, *good[1:])]
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "i int, capacity_factor double, turbine_rating double, electricity_price double, capex_per_mw double, lifetime int, grid_carbon_intensity double",
    )
    checked = sg.check_scenarios(df).orderBy("i").collect()
    assert [row.valid for row in checked] == [True, True, True, False, False]
    assert checked[3].out_of_range == "capacity_factor,lifetime" and checked[4].out_of_range == "capacity_factor"


def test_details_and_headlines(register):
    details = {r.field: r.value for r in sg.project_details(register).where("ref_id = 1").collect()}
    assert len(details) == 9 and details["Operator / Applicant"] == "South Power" and details["County"] == "N/A"
    head = sg.project_headlines(register).where("ref_id = 0").collect()[0]
    assert (head.technology_text, head.capacity_text, head.status_text, head.score_text) == ("Wind Offshore", "100.0 MW", "Operational", "81/100")


def test_briefs(register):
    briefs = {r.site_name: r for r in sg.project_briefs(sg.first_by_name(register)).collect()}
    assert briefs["Delta / x:y\\z"].file_name == "Delta_-_x-y-z_project_brief.txt"
    lines = briefs["Alpha"].brief.split("\n")
    assert lines[:5] == ["", "Renewable Project Brief", "=======================", "", "Project: Alpha"]
    assert "Installed Capacity: 100.0 MW" in lines and "Screening Score: 81/100" in lines and "Country: N/A" in lines
    assert lines[-1] == ""


def test_brief_text_is_literal(register):
    brief = sg.project_briefs(register.where("ref_id = 0"), note=("{region}",)).collect()[0].brief
    assert brief.endswith("-----------------\n{region}")


def test_plain_numbers(spark):
    from siteglass.functions.text import plain_number

    values = [0.0, 1.0, 0.1, 12345678.0, 123456789.125, 0.0005, 0.00012, 1e15, 99.95, -25000000.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(plain_number(F.col("v"))).collect()] == [repr(v) for v in values]


def test_briefs_sink(register, spark, tmp_path):
    sg.write_briefs(sg.project_briefs(sg.first_by_name(register)), str(tmp_path / "briefs"))
    assert spark.read.parquet(str(tmp_path / "briefs")).columns == ["site_name", "file_name", "brief"]


NUMBER_TEXTS = (1e-5, 2.5e-6, 1e-4, 0.00012345, 1e-3, 0.0, 1.0, 12345678.0, 1e15, 123456789012345.6, 1e16, 2.5e16, 1e22, 1e300, 1e-300, float("inf"), float("nan"))


def test_number_texts(spark):
    values = [*NUMBER_TEXTS, *(-x for x in NUMBER_TEXTS)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    texts = [r[0] for r in df.select(plain_number(F.col("x"))).collect()]
    assert texts == [repr(x) for x in values[: len(NUMBER_TEXTS)]] + [repr(-x) if x == x else "nan" for x in NUMBER_TEXTS]


def test_filter_choices(register):
    own = sg.facets(register, ["technology", "status", "region", "site_name"]).collect()
    found = sg.filter_choices(register).collect()
    assert [tuple(r) for r in found if r.facet != "offshore_site_name"] == [tuple(r) for r in own]
    assert [r.value for r in found if r.facet == "offshore_site_name"] == sorted(
        {r.site_name for r in sg.offshore_projects(register).collect() if r.site_name is not None}
    )


def spread_sums(spark, parts, seed):
    """Two technologies, regions and stages each with equal totals, whose double sums depend on the order of rows."""
    rng = random.Random(seed)
    values = [round(rng.uniform(0, 1200), 1) for _ in range(400)] + [1e15 + 0.5, 1e-9, 0.1, 0.2]
    rows = []
    for key in ("B", "A"):
        for i, v in enumerate(rng.sample(values, len(values))):
            rows.append((len(rows), f"n{i}", key, v, key.lower(), "s" + key, 1))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, PROJECT_SCHEMA).repartition(parts), math.fsum(values), len(values)


def test_equal_totals_rank_by_key_however_rows_are_partitioned(spark):
    plain = set()
    for parts in range(1, 21):
        df, whole, n = spread_sums(spark, parts, parts)
        plain |= {r[0] for r in df.groupBy("technology").agg(F.sum("capacity_mw")).select(F.col("sum(capacity_mw)")).collect()}
        groups = sg.capacity_groups(df)
        for source in (df, groups):
            assert [tuple(r) for r in sg.capacity_by(source, "technology").collect()] == [("A", whole), ("B", whole)]
            assert sorted(map(tuple, sg.leading_groups(source).collect())) == [("region", "a", whole), ("technology", "A", whole)]
            assert sorted(map(tuple, sg.capacity_matrix(source, top=1).collect())) == [("A", "sA", whole)]
        for k in (sg.kpis(df), sg.group_kpis(groups), sg.group_kpis(sg.capacity_groups(groups.repartition(parts)))):
            assert [tuple(r)[:3] for r in k.collect()] == [(2 * n, 2 * whole, 2 * whole / (2 * n))]
        assert sg.top_share(df, 2).collect()[0][:2] == (2e15 + 1, 2 * whole)
    assert len(plain) > 2  # what plain sums make of the same rows


def test_sums_are_those_of_the_numbers_as_written(spark):
    rng = random.Random(4)
    kinds = [lambda: round(rng.uniform(-2e9, 2e9), rng.randint(0, 9)), lambda: rng.uniform(-5, 5), lambda: rng.randint(-50, 50) / 10, lambda: 123456.789012, lambda: -0.000001]
    for kind in [*kinds, lambda: rng.choice(kinds)()]:
        values = [kind() for _ in range(300)]
        df = spark.createDataFrame([(i, "n", "T", v, "r", "s", 1) for i, v in enumerate([*values, None])], PROJECT_SCHEMA)
        want = sum(decimal.Decimal(repr(v)).quantize(decimal.Decimal("1e-12"), decimal.ROUND_HALF_UP) for v in values)
        assert [r.capacity_mw for r in sg.capacity_by(df, "technology").collect()] == [float(want)]


def test_sums_of_numbers_that_no_decimal_holds(spark):
    rows = [(i, "n", t, v, "r", "s", 1) for i, (t, v) in enumerate([("A", 1e300), ("A", 2.5), ("B", float("inf")), ("B", 1.0), ("C", None), ("D", -1e17), ("D", 0.1)])]
    df = spark.createDataFrame(rows, PROJECT_SCHEMA).repartition(3)
    want = [("B", math.inf), ("A", 1e300), ("D", -1e17 + 0.1), ("C", None)]
    for source in (df, sg.capacity_groups(df)):
        assert [tuple(r) for r in sg.capacity_by(source, "technology").collect()] == want
    k = sg.kpis(df.where("technology = 'C' or technology = 'D'")).collect()[0]
    assert (k.projects, k.total_capacity_mw, k.average_capacity_mw) == (3, -1e17 + 0.1, (-1e17 + 0.1) / 2)
