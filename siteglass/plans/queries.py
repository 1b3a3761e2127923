"""The registered queries: each operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import siteglass as sg
from siteglass.functions.text import plain_number
from siteglass.schema import CSV_HEADERS
from siteglass.sources.tables import projects_raw, read_table
from siteglass.sources.workspace import new_dir

SEARCH_TEXT = "BUILDING Power"
SEARCH_RARE = "REF/149"
SEARCH_REGEX = "power.*(battery|storage) awaiting"
TECHNOLOGY, STATUS, REGION = "Solar Photovoltaics", "Planning Granted", "EUROPE"

CHOSEN_NAME = "Customer#000000002 site"
NOWHERE = "ATLANTIS"
# About as many rows go into a file of the registers that queries write.
_FILE_ROWS = 20_000

_SHORT = ("ref_id", "site_name", "technology", "capacity_mw", "status", "region")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and scored. Most queries need no map position, so none is worked out."""
    return sg.with_score(sg.clean(projects_raw(spark, sf_dir)))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.prepare(projects_raw(spark, sf_dir))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model assumptions per order line, some of them out of range."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ref_id"),
        F.col("l_linenumber").alias("run"),
        (((F.col("l_orderkey") % 65) + 10).cast("double") / 100).alias("capacity_factor"),
        F.col("l_quantity").alias("turbine_rating"),
        ((F.col("l_partkey") % 50) * 5).cast("double").alias("electricity_price"),
        ((F.col("l_suppkey") % 10) + 0.5).cast("double").alias("capex_per_mw"),
        ((F.col("l_partkey") % 45) + 1).cast("int").alias("lifetime"),
        ((F.col("l_orderkey") % 7).cast("double") / 10).alias("grid_carbon_intensity"),
    )


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round coordinates, which two engines work out in different ways."""
    return df.withColumns({name: F.round(name, digits) for name in names})


def _filtered(**choices):
    return lambda df: sg.apply_filters(df, **choices).select(*_SHORT, "score")


def _capacity_by(column, n):
    return lambda df: sg.capacity_by(df, column, n=n)


_FIGURES = (
    "annual_energy_mwh",
    "turbines",
    "annual_revenue",
    "total_capex",
    "simple_payback",
    "lifetime_revenue",
    "annual_carbon_t",
    "lifetime_carbon_t",
)


def _offshore_model(df):
    return sg.offshore_model(sg.offshore_projects(df)).select("ref_id", "site_name", "capacity_mw", *_FIGURES)


# Queries on projects that are cleaned and scored, and where marked also located.
ON_PROJECTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "screening_score": lambda df: df.select("ref_id", "score"),
    "search_text": _filtered(query=SEARCH_TEXT),
    "search_regex": _filtered(query=SEARCH_REGEX),
    "filter_technology": _filtered(technology=TECHNOLOGY),
    "filter_status": _filtered(status=STATUS),
    "filter_region": _filtered(region=REGION),
    "filter_combined": _filtered(technology=TECHNOLOGY, status=STATUS, region=REGION, query="site"),
    "facet_options": sg.filter_choices,
    "offshore_projects": lambda df: sg.offshore_projects(df).select(*_SHORT, "score"),
    "dataset_summary": sg.dataset_summary,
    "kpi_summary": sg.kpis,
    "empty_selection": lambda df: sg.kpis(sg.apply_filters(df, region=NOWHERE)),
    "kpi_from_groups": lambda df: sg.group_kpis(sg.capacity_groups(df)),
    "capacity_by_technology": _capacity_by("technology", 8),
    "capacity_by_region": _capacity_by("region", 8),
    "capacity_by_stage": _capacity_by("status", 10),
    "leading_groups": sg.leading_groups,
    "largest_project": sg.largest_project,
    "top10_share": sg.top_share,
    "technology_by_stage": sg.capacity_matrix,
    "major_projects": sg.major_projects,
    "preview_projects": sg.preview,
    "first_by_name": lambda df: sg.first_by_name(df).select(*_SHORT, "score"),
    "comparables": sg.comparables,
    "comparables_of_one": lambda df: sg.comparables_of(df, CHOSEN_NAME),
    "offshore_model": _offshore_model,
    "offshore_texts": lambda df: sg.offshore_texts(sg.offshore_model(sg.offshore_projects(df))),
    "offshore_sensitivity": lambda df: sg.offshore_sensitivity(sg.offshore_projects(df)),
    "project_details": lambda df: sg.project_details(sg.first_by_name(df)),
    "project_headlines": lambda df: sg.project_headlines(sg.first_by_name(df)),
    "project_briefs": lambda df: sg.project_briefs(sg.first_by_name(df)),
}
ON_LOCATED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "coords": lambda df: _rounded(df.select("ref_id", "x", "y", "lon", "lat"), 6, "lon", "lat"),
    "map_points": lambda df: _rounded(sg.map_points(df), 6, "lat", "lon"),
}


def _ingest_clean(spark, sf_dir):
    return sg.clean(projects_raw(spark, sf_dir))


def _score_components(spark, sf_dir):
    return sg.with_score(_ingest_clean(spark, sf_dir), components=True).select(
        "ref_id", "capacity_points", "status_points", "technology_points", "completeness_points", "score"
    )


def _offshore_scenarios(spark, sf_dir):
    """Every offshore project under its own accepted assumptions, joined by key."""
    accepted = sg.check_scenarios(scenarios(spark, sf_dir)).where("valid")
    runs = sg.with_offshore_figures(sg.offshore_projects(projects(spark, sf_dir)).join(accepted, "ref_id"))
    return runs.select("ref_id", "run", "capacity_mw", *_FIGURES)


def _export_filtered(spark, sf_dir):
    path = new_dir(spark, "export")
    sg.export_csv(sg.apply_filters(located(spark, sf_dir), region=REGION, query="power"), path)
    return _rounded(sg.read_export(spark, path), 6, "lon", "lat")


def _register_csv(spark, sf_dir):
    """The whole register written as Latin-1 CSV and read as a source."""
    path = new_dir(spark, "register")
    sg.write_register_csv(projects_raw(spark, sf_dir), path)
    return sg.clean(sg.read_register(spark, path)).drop("ref_id")


def _register_order(spark, sf_dir):
    """The register in files of very different sizes, named against the order of their keys; each row's place."""
    path = new_dir(spark, "register")
    raw = projects_raw(spark, sf_dir)
    ends, rows = raw.agg(F.max("ref_id"), F.count(F.lit(1))).first()
    last, before = -1, 0.0
    for k, share in enumerate((0.02, 0.6, 0.61, 1.0)):
        end = int((ends or 0) * share)
        # Files of a folder are named in the order of their ranges.
        files = 1 + int(rows * (share - before)) // _FILE_ROWS
        part = raw.where((F.col("ref_id") > last) & (F.col("ref_id") <= end)).repartitionByRange(files, "ref_id").sortWithinPartitions("ref_id")
        sg.write_register_csv(part, f"{path}/{9 - k}")
        last, before = end, share
    places = sg.read_register(spark, f"{path}/*/*.csv")
    return places.select(F.col("ref_id").alias("place"), "site_name", "planning_ref", "capacity_raw")


def _register_short_rows(spark, sf_dir):
    """The register as lines that end after their last filled cell, a few of them with a very long quoted cell."""
    path = new_dir(spark, "register")
    raw = projects_raw(spark, sf_dir).withColumns(
        {
            "operator": F.when(F.col("ref_id") % 249 == 0, F.repeat(F.lit('Consortium "x", '), 400)).otherwise(F.col("operator")),
            "last_updated_raw": F.when(F.col("ref_id") % 3 != 0, F.col("last_updated_raw")),
        }
    )
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(name, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for name in CSV_HEADERS]
    line = F.regexp_replace(F.array_join(F.array(*cells), ","), '(,"")+$', "")
    header = spark.createDataFrame([(",".join(CSV_HEADERS.values()),)], "line string")
    # Every file begins with the header: a line per file number, sorted before the rows.
    number = 3 + raw.count() // _FILE_ROWS
    files = F.pmod(F.xxhash64("ref_id"), F.lit(number))
    rows = raw.select(files.alias("file"), F.lit(1).alias("order"), line.alias("line"))
    heads = header.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint"))).alias("file"), F.lit(0).alias("order"), "line")
    lines = heads.union(rows).repartition(number, "file").sortWithinPartitions("file", "order").select("file", "line")
    lines.write.partitionBy("file").option("encoding", "ISO-8859-1").text(path)
    return sg.clean(sg.read_register(spark, f"{path}/*/*.txt", multi_line=False)).drop("ref_id")


def _two_deliveries(spark, sf_dir):
    """The register in two deliveries, the later rows first; where they are landed."""
    path = new_dir(spark, "deliveries")
    raw = projects_raw(spark, sf_dir)
    ends, rows = raw.agg(F.max("ref_id"), F.count(F.lit(1))).first()
    late = F.col("ref_id") > (ends or 0) // 2
    for part in (raw.where(late), raw.where(~late)):
        ordered = part.repartitionByRange(2 + rows // _FILE_ROWS, "ref_id").sortWithinPartitions("ref_id")
        sg.write_register_csv(ordered, f"{path}/in", mode="append")
        sg.land_deliveries(spark, f"{path}/in", f"{path}/landed")
    return f"{path}/landed"


def _deliveries_landed(spark, sf_dir):
    return sg.read_landed(spark, _two_deliveries(spark, sf_dir)).select("ref_id", "site_name", "planning_ref", "capacity_mw", "score")


def _deliveries_kpis(spark, sf_dir):
    return sg.group_kpis(sg.kept_groups(spark, _two_deliveries(spark, sf_dir)))


def _landed_projects(spark, sf_dir):
    path = new_dir(spark, "projects")
    sg.write_projects(located(spark, sf_dir), path)
    return _rounded(sg.read_projects(spark, path), 6, "lon", "lat")


def _search_landed(query):
    """A search through the table of strings of a register landed in many files."""

    def run(spark, sf_dir):
        path = new_dir(spark, "searched")
        df = projects(spark, sf_dir)
        sg.write_projects(df.repartitionByRange(8 + df.count() // _FILE_ROWS, "ref_id"), f"{path}/projects")
        sg.write_search_index(spark, f"{path}/projects", f"{path}/strings")
        return sg.search_landed(spark, f"{path}/projects", f"{path}/strings", query).select(*_SHORT, "score")

    return run


def _clustered(spark, sf_dir):
    """One region, read from a register that is landed by interleaved choices."""
    path = new_dir(spark, "clustered")
    sg.write_projects(projects(spark, sf_dir), path, clustered=True)
    return sg.apply_filters(sg.read_projects(spark, path), region=REGION).select(*_SHORT, "score")


def _comparables_among(spark, sf_dir):
    """The sites of every tenth customer."""
    named = read_table(spark, sf_dir, "customer").where("c_custkey % 10 = 1").select(F.concat("c_name", F.lit(" site")).alias("site_name"))
    return sg.comparables_among(projects(spark, sf_dir), named)


def _briefs_written(spark, sf_dir):
    """Briefs as files, for names with signs that file names can't hold."""
    signs = F.element_at(F.array(*map(F.lit, ("a/b", "c\\d", "e:f", "g h/\\:"))), (F.col("ref_id") % 4 + 1).cast("int"))
    named = sg.first_by_name(projects(spark, sf_dir)).withColumn("site_name", F.concat("site_name", F.lit(" "), signs))
    path = new_dir(spark, "briefs")
    sg.write_briefs(sg.project_briefs(named), path)
    return sg.read_briefs(spark, path)


def _number_texts(spark, sf_dir):
    """Order prices from very small to very large, as briefs write them."""
    factors = F.array(*map(F.lit, (1.0, 1e-9, -1e-8, 1e3, 1e11, -1e12, 1e290, 0.0)))
    price = F.col("o_totalprice") * F.element_at(factors, (F.col("o_orderkey") % 8 + 1).cast("int"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", plain_number(price).alias("text"))


def _on(source, plan):
    return lambda spark, sf_dir: plan(source(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_clean": _ingest_clean,
    "register_csv": _register_csv,
    "register_order": _register_order,
    "register_short_rows": _register_short_rows,
    "deliveries_landed": _deliveries_landed,
    "deliveries_kpis": _deliveries_kpis,
    "landed_projects": _landed_projects,
    "search_landed_text": _search_landed(SEARCH_RARE),
    "search_landed_regex": _search_landed(SEARCH_REGEX),
    "filter_region_clustered": _clustered,
    "comparables_among": _comparables_among,
    "briefs_written": _briefs_written,
    "number_texts": _number_texts,
    "score_components": _score_components,
    "scenario_check": lambda spark, sf_dir: sg.check_scenarios(scenarios(spark, sf_dir)),
    "offshore_scenarios": _offshore_scenarios,
    "export_filtered": _export_filtered,
    **{name: _on(projects, plan) for name, plan in ON_PROJECTS.items()},
    **{name: _on(located, plan) for name, plan in ON_LOCATED.items()},
}
