"""DuckDB SQL that answers every registered query by itself.

Written apart from the operators: brute force instead of an ordered pass for the
comparables, iteration instead of closed forms for the coordinates.
"""

from __future__ import annotations

from siteglass.sources.tables import PROJECTS_RAW_SQL, TABLES

_TEXT = (
    "site_name operator technology status region county country planning_authority planning_ref "
    "planning_submitted planning_granted operational_date last_updated_raw"
).split()
_MISSING = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)
_RAW = PROJECTS_RAW_SQL.format(**{name: name for name in TABLES})


def _number(cell: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(trim({cell}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
        f"THEN TRY_CAST(trim({cell}) AS DOUBLE) END"
    )


_TEXT_CELLS = ", ".join(f"CASE WHEN {c} IN ({_MISSING}) THEN NULL ELSE {c} END AS {c}" for c in _TEXT)

_PARTS = """
 CASE WHEN capacity_mw >= 1000 THEN 35 WHEN capacity_mw >= 500 THEN 28 WHEN capacity_mw >= 100 THEN 20
  WHEN capacity_mw >= 20 THEN 12 ELSE 5 END AS capacity_points,
 CASE WHEN lower(status) LIKE '%operational%' THEN 35 WHEN lower(status) LIKE '%construction%' THEN 30
  WHEN lower(status) LIKE '%planning granted%' THEN 25 WHEN lower(status) LIKE '%planning%' THEN 15 ELSE 8 END AS status_points,
 CASE WHEN lower(technology) LIKE '%wind offshore%' THEN 20 WHEN lower(technology) LIKE '%battery%' THEN 18
  WHEN lower(technology) LIKE '%storage%' THEN 18 WHEN lower(technology) LIKE '%solar%' THEN 15
  WHEN lower(technology) LIKE '%wind onshore%' THEN 15 ELSE 10 END AS technology_points,
 CAST(least(10, 2 * (
  CASE WHEN trim(operator) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(region) <> '' THEN 1 ELSE 0 END
  + CASE WHEN trim(county) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(planning_authority) <> '' THEN 1 ELSE 0 END
  + CASE WHEN trim(planning_ref) <> '' THEN 1 ELSE 0 END)) AS INTEGER) AS completeness_points
"""

_BASE = f"""
raw AS ({_RAW}),
cleaned AS (
 SELECT ref_id, {_TEXT_CELLS}, {_number("capacity_raw")} AS capacity_mw, {_number("x_raw")} AS x, {_number("y_raw")} AS y,
  CAST(try_strptime(last_updated_raw, '%d/%m/%Y') AS DATE) AS last_updated
 FROM raw WHERE {_number("capacity_raw")} IS NOT NULL),
parts AS (SELECT *, {_PARTS} FROM cleaned),
projects AS MATERIALIZED (
 SELECT *, CAST(least(100, capacity_points + status_points + technology_points + completeness_points) AS INTEGER) AS score
 FROM parts),
named AS (
 SELECT * FROM projects WHERE site_name IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY site_name ORDER BY ref_id) = 1),
offshore AS (SELECT * FROM projects WHERE lower(technology) LIKE '%wind offshore%')
"""

# Grid to WGS84, one materialised CTE per step: nested expressions would grow
# beyond what the planner can take. As published.
_FOOT_ROUNDS, _LAT_ROUNDS = 5, 5


def _located() -> str:
    a, b, scale = 6377563.396, 6356256.909, 0.9996012717
    n = (a - b) / (a + b)
    e2 = (a * a - b * b) / (a * a)
    wa, wb = 6378137.0, 6356752.314245
    we2 = (wa * wa - wb * wb) / (wa * wa)
    radius = scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def arc(phi: str) -> str:
        return (
            f"({phi} - {3 * n / 2 - 9 * n**3 / 16!r}::DOUBLE * sin(2 * {phi}) + {15 * n**2 / 16 - 15 * n**4 / 32!r}::DOUBLE * sin(4 * {phi})"
            f" - {35 * n**3 / 48!r}::DOUBLE * sin(6 * {phi}) + {315 * n**4 / 512!r}::DOUBLE * sin(8 * {phi}))"
        )

    north = f"(y + 100000.0::DOUBLE) / {radius!r}::DOUBLE + {arc('radians(49.0::DOUBLE)')}"
    steps = [f"SELECT ref_id, x, y, x - 400000.0::DOUBLE AS d, {north} AS mu, {north} AS phi FROM projects WHERE x IS NOT NULL AND y IS NOT NULL"]
    for _ in range(_FOOT_ROUNDS):
        steps.append(f"SELECT * REPLACE (phi + mu - {arc('phi')} AS phi) FROM {{last}}")
    steps += [
        f"SELECT *, {a * scale!r}::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * sin(phi) * sin(phi)) AS nu, tan(phi) AS t, 1 / cos(phi) AS sec FROM {{last}}",
        f"SELECT *, nu * {1 - e2!r}::DOUBLE / (1 - {e2!r}::DOUBLE * sin(phi) * sin(phi)) AS rho FROM {{last}}",
        "SELECT *, nu / rho - 1 AS eta2 FROM {last}",
        """SELECT ref_id, x, y,
          phi - t / (2 * rho * nu) * d**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta2 - 9 * t**2 * eta2) * d**4
           - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * d**6 AS la,
          radians(-2.0::DOUBLE) + sec / nu * d - sec / (6 * nu**3) * (nu / rho + 2 * t**2) * d**3
           + sec / (120 * nu**5) * (5 + 28 * t**2 + 24 * t**4) * d**5
           - sec / (5040 * nu**7) * (61 + 662 * t**2 + 1320 * t**4 + 720 * t**6) * d**7 AS lo FROM {last}""",
        f"SELECT *, {a!r}::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * sin(la) * sin(la)) AS nu FROM {{last}}",
        f"SELECT ref_id, x, y, nu * cos(la) * cos(lo) AS ax, nu * cos(la) * sin(lo) AS ay, nu * {1 - e2!r}::DOUBLE * sin(la) AS az FROM {{last}}",
        """SELECT ref_id, x, y,
          446.448::DOUBLE + (1 - 20.4894e-6) * ax - radians(0.8421e0 / 3600) * ay + radians(0.2470e0 / 3600) * az AS bx,
          -125.157::DOUBLE + radians(0.8421e0 / 3600) * ax + (1 - 20.4894e-6) * ay - radians(0.1502e0 / 3600) * az AS by_,
          542.060::DOUBLE - radians(0.2470e0 / 3600) * ax + radians(0.1502e0 / 3600) * ay + (1 - 20.4894e-6) * az AS bz FROM {last}""",
        f"SELECT *, sqrt(bx * bx + by_ * by_) AS p, atan2(bz, sqrt(bx * bx + by_ * by_) * {1 - we2!r}::DOUBLE) AS la FROM {{last}}",
    ]
    for _ in range(_LAT_ROUNDS):
        steps.append(
            f"SELECT * REPLACE (atan2(bz + {we2 * wa!r}::DOUBLE * sin(la) / sqrt(1 - {we2!r}::DOUBLE * sin(la) * sin(la)), p) AS la) FROM {{last}}"
        )
    steps.append("SELECT ref_id, round(degrees(atan2(by_, bx)), 6) AS lon, round(degrees(la), 6) AS lat FROM {last}")
    ctes = [f"g{i} AS MATERIALIZED ({step.format(last=f'g{i - 1}')})" for i, step in enumerate(steps)]
    joined = f"located AS (SELECT p.*, g.lon, g.lat FROM projects p LEFT JOIN g{len(steps) - 1} g ON p.ref_id = g.ref_id)"
    return ",\n".join([*ctes, joined])


def _q(select: str, located: bool = False) -> str:
    return f"WITH {_BASE}{', ' + _located() if located else ''}\n{select}"


_SHORT = "ref_id, site_name, technology, capacity_mw, status, region, score"
_HAYSTACK = "lower(concat_ws(' ', " + ", ".join(
    f"coalesce({c}, '')"
    for c in "site_name operator technology status region county planning_authority planning_ref".split()
) + "))"


def _choose(condition: str) -> str:
    return _q(f"SELECT {_SHORT} FROM projects WHERE {condition}")


# Capacities of these registers have one decimal place; as decimals they add up exactly, in any order.
_SUM = "CAST(sum(CAST(capacity_mw AS DECIMAL(38,4))) AS DOUBLE)"


def _top_groups(column: str, n: int) -> str:
    return _q(
        f"SELECT {column}, {_SUM} AS capacity_mw FROM projects WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY {_SUM} DESC, {column} LIMIT {n}"
    )


def _leader(column: str) -> str:
    return (
        f"(SELECT '{column}' AS facet, {column} AS value, {_SUM} AS capacity_mw FROM projects "
        f"WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY {_SUM} DESC, {column} LIMIT 1)"
    )


def _options(facet: str, column: str, table: str = "projects") -> str:
    return f"SELECT DISTINCT '{facet}' AS facet, {column} AS value FROM {table} WHERE {column} IS NOT NULL"


def _model(source: str, keys: str, factors: dict[str, str]) -> str:
    return f"""SELECT {keys}, annual_energy_mwh, turbines, annual_revenue, total_capex,
     CASE WHEN annual_revenue <> 0 THEN total_capex / annual_revenue END AS simple_payback,
     annual_revenue * {factors["lifetime"]} AS lifetime_revenue,
     annual_carbon_t, annual_carbon_t * {factors["lifetime"]} AS lifetime_carbon_t
    FROM (SELECT *, annual_energy_mwh * {factors["electricity_price"]} AS annual_revenue,
      annual_energy_mwh * {factors["grid_carbon_intensity"]} AS annual_carbon_t
     FROM (SELECT *, capacity_mw * {factors["capacity_factor"]} * 8760 AS annual_energy_mwh,
       capacity_mw / {factors["turbine_rating"]} AS turbines,
       capacity_mw * {factors["capex_per_mw"]} * 1e6 AS total_capex FROM {source}))"""


_DEFAULTS = {
    "capacity_factor": "0.45::DOUBLE",
    "turbine_rating": "15.0::DOUBLE",
    "electricity_price": "70.0::DOUBLE",
    "capex_per_mw": "3.0::DOUBLE",
    "lifetime": "25",
    "grid_carbon_intensity": "0.2::DOUBLE",
}

_SCENARIOS = """
scenarios AS (
 SELECT l_orderkey AS ref_id, l_linenumber AS run, CAST(l_orderkey % 65 + 10 AS DOUBLE) / 100 AS capacity_factor,
  l_quantity AS turbine_rating, CAST(l_partkey % 50 * 5 AS DOUBLE) AS electricity_price,
  CAST(l_suppkey % 10 AS DOUBLE) + 0.5::DOUBLE AS capex_per_mw, CAST(l_partkey % 45 + 1 AS INTEGER) AS lifetime,
  CAST(l_orderkey % 7 AS DOUBLE) / 10 AS grid_carbon_intensity
 FROM lineitem),
checked AS (
 SELECT *, concat_ws(',',
  CASE WHEN capacity_factor < 0.2::DOUBLE OR capacity_factor > 0.7::DOUBLE THEN 'capacity_factor' END,
  CASE WHEN turbine_rating < 5 OR turbine_rating > 25 THEN 'turbine_rating' END,
  CASE WHEN electricity_price < 20 OR electricity_price > 200 THEN 'electricity_price' END,
  CASE WHEN capex_per_mw < 1 OR capex_per_mw > 8 THEN 'capex_per_mw' END,
  CASE WHEN lifetime < 10 OR lifetime > 40 THEN 'lifetime' END,
  CASE WHEN grid_carbon_intensity < 0 OR grid_carbon_intensity > 0.6::DOUBLE THEN 'grid_carbon_intensity' END) AS out_of_range
 FROM scenarios)
"""

_DETAILS = "\nUNION ALL ".join(
    f"SELECT ref_id, site_name, '{label}' AS field, coalesce({column}, 'N/A') AS value FROM named"
    for label, column in (
        ("Operator / Applicant", "operator"),
        ("Region", "region"),
        ("County", "county"),
        ("Country", "country"),
        ("Planning Authority", "planning_authority"),
        ("Planning Application Reference", "planning_ref"),
        ("Planning Submitted", "planning_submitted"),
        ("Planning Granted", "planning_granted"),
        ("Operational Date", "operational_date"),
    )
)


def _brief() -> str:
    def cell(column: str) -> str:
        return f"coalesce(CAST({column} AS VARCHAR), 'N/A')"

    lines = [
        "''",
        "'Renewable Project Brief'",
        "'======================='",
        "''",
        "'Project: ' || site_name",
        "''",
        "'1. Project Overview'",
        "'-------------------'",
        f"'Technology: ' || {cell('technology')}",
        f"'Installed Capacity: ' || {cell('capacity_mw')} || ' MW'",
        f"'Development Status: ' || {cell('status')}",
        f"'Screening Score: ' || {cell('score')} || '/100'",
        "''",
        "'2. Developer and Location'",
        "'-------------------------'",
        f"'Operator / Applicant: ' || {cell('operator')}",
        f"'Region: ' || {cell('region')}",
        f"'County: ' || {cell('county')}",
        f"'Country: ' || {cell('country')}",
        "''",
        "'3. Planning Information'",
        "'-----------------------'",
        f"'Planning Authority: ' || {cell('planning_authority')}",
        f"'Planning Application Reference: ' || {cell('planning_ref')}",
        f"'Planning Submitted: ' || {cell('planning_submitted')}",
        f"'Planning Granted: ' || {cell('planning_granted')}",
        f"'Operational Date: ' || {cell('operational_date')}",
        "''",
        "'4. Interpretation'",
        "'-----------------'",
        "'Points out of 100: capacity up to 35, development stage up to 35, technology'",
        "'up to 20, and 2 for each of five register fields that is filled in.'",
        "''",
    ]
    return " || chr(10) || ".join(lines)


_KPIS = f"""SELECT count(*) AS projects, coalesce({_SUM}, 0) AS total_capacity_mw,
         {_SUM} / count(capacity_mw) AS average_capacity_mw, max(last_updated) AS latest_update,
         format('{{:,.0f}} MW', round({_SUM}, 6)) AS total_capacity_text,
         format('{{:,.1f}} MW', round({_SUM} / count(capacity_mw), 6)) AS average_capacity_text,
         coalesce(strftime(max(last_updated), '%d %b %Y'), 'N/A') AS latest_update_text FROM projects"""

_CLEAN_COLUMNS = ", ".join([*_TEXT, "capacity_mw", "x", "y", "last_updated"])

_COMPARABLES = """SELECT a.ref_id, a.site_name, a.technology, a.capacity_mw,
         CAST(row_number() OVER (PARTITION BY a.ref_id ORDER BY b.capacity_mw DESC, b.ref_id) AS INTEGER) AS place,
         b.ref_id AS comparable_ref_id, b.site_name AS comparable_site_name, b.capacity_mw AS comparable_capacity_mw,
         b.region AS comparable_region, b.status AS comparable_status, b.score AS comparable_score
        FROM named a JOIN projects b ON a.technology = b.technology
         AND b.capacity_mw >= a.capacity_mw * 0.7::DOUBLE AND b.capacity_mw <= a.capacity_mw * 1.3::DOUBLE
         AND a.site_name IS DISTINCT FROM b.site_name
        QUALIFY place <= 5"""

ORACLE_SQL: dict[str, str] = {
    "ingest_clean": _q(f"SELECT ref_id, {_CLEAN_COLUMNS} FROM projects"),
    "coords": _q("SELECT ref_id, x, y, lon, lat FROM located", located=True),
    "screening_score": _q("SELECT ref_id, score FROM projects"),
    "score_components": _q(
        "SELECT ref_id, capacity_points, status_points, technology_points, completeness_points, score FROM projects"
    ),
    "search_text": _choose(f"contains({_HAYSTACK}, 'building power')"),
    "search_regex": _choose(f"regexp_matches({_HAYSTACK}, 'power.*(battery|storage) awaiting')"),
    "filter_technology": _choose("technology = 'Solar Photovoltaics'"),
    "filter_status": _choose("status = 'Planning Granted'"),
    "filter_region": _choose("region = 'EUROPE'"),
    "filter_combined": _choose(
        f"contains({_HAYSTACK}, 'site') AND technology = 'Solar Photovoltaics' AND status = 'Planning Granted' AND region = 'EUROPE'"
    ),
    "facet_options": _q(
        " UNION ALL ".join(
            [_options(c, c) for c in ("technology", "status", "region", "site_name")]
            + [_options("offshore_site_name", "site_name", "offshore")]
        )
    ),
    "offshore_projects": _q(f"SELECT {_SHORT} FROM offshore"),
    "dataset_summary": _q(
        "SELECT count(*) AS records, max(last_updated) AS latest_update, "
        "coalesce(strftime(max(last_updated), '%d %b %Y'), 'N/A') AS latest_update_text FROM projects"
    ),
    "kpi_summary": _q(_KPIS),
    "kpi_from_groups": _q(_KPIS),
    "empty_selection": _q(
        """SELECT count(*) AS projects, coalesce(sum(capacity_mw), 0) AS total_capacity_mw, avg(capacity_mw) AS average_capacity_mw,
         max(last_updated) AS latest_update, '0 MW' AS total_capacity_text,
         format('{:,.1f} MW', avg(capacity_mw)) AS average_capacity_text, 'N/A' AS latest_update_text
        FROM projects WHERE region = 'ATLANTIS'"""
    ),
    "capacity_by_technology": _top_groups("technology", 8),
    "capacity_by_region": _top_groups("region", 8),
    "capacity_by_stage": _top_groups("status", 10),
    "leading_groups": _q(_leader("technology") + " UNION ALL " + _leader("region")),
    "largest_project": _q(
        "SELECT ref_id, site_name, capacity_mw, format('{:,.0f} MW', capacity_mw) AS capacity_text "
        "FROM projects ORDER BY capacity_mw DESC, ref_id LIMIT 1"
    ),
    "top10_share": _q(
        f"""SELECT top AS top_capacity_mw, total AS total_capacity_mw, top / total * 100 AS share_percent,
         format('{{:,.1f}}%', round(top / total * 100, 6)) AS share_text
        FROM (SELECT {_SUM} AS total FROM projects),
         (SELECT {_SUM} AS top FROM (SELECT capacity_mw FROM projects ORDER BY capacity_mw DESC, ref_id LIMIT 10))"""
    ),
    "technology_by_stage": _q(
        f"""SELECT technology, status, {_SUM} AS capacity_mw FROM projects
        WHERE status IS NOT NULL AND technology IN (
         SELECT technology FROM projects WHERE technology IS NOT NULL GROUP BY technology
         ORDER BY {_SUM} DESC, technology LIMIT 6)
        GROUP BY technology, status"""
    ),
    "major_projects": _q(
        "SELECT site_name, technology, capacity_mw, region, status, score FROM projects "
        "ORDER BY capacity_mw DESC, ref_id LIMIT 10"
    ),
    "preview_projects": _q(
        "SELECT site_name, operator, technology, capacity_mw, status, region, county, planning_authority, score "
        "FROM projects ORDER BY ref_id LIMIT 250"
    ),
    "map_points": _q(
        "SELECT ref_id, site_name, lat, lon, capacity_mw, technology, region, status, score FROM located "
        "WHERE lat IS NOT NULL AND lon IS NOT NULL",
        located=True,
    ),
    "first_by_name": _q(f"SELECT {_SHORT} FROM named"),
    "comparables": _q(_COMPARABLES),
    "comparables_of_one": _q(_COMPARABLES.replace("QUALIFY", "WHERE a.site_name = 'Customer#000000002 site' QUALIFY")),
    "comparables_among": _q(
        _COMPARABLES.replace("QUALIFY", "WHERE a.site_name IN (SELECT c_name || ' site' FROM customer WHERE c_custkey % 10 = 1) QUALIFY")
    ),
    "search_landed_text": _choose(f"contains({_HAYSTACK}, 'ref/149')"),
    "search_landed_regex": _choose(f"regexp_matches({_HAYSTACK}, 'power.*(battery|storage) awaiting')"),
    "filter_region_clustered": _choose("region = 'EUROPE'"),
    "offshore_model": _q(_model("offshore", "ref_id, site_name, capacity_mw", _DEFAULTS)),
    "offshore_texts": _q(
        f"""SELECT ref_id, site_name, format('{{:,.0f}} MW', capacity_mw) AS capacity_text,
         format('{{:,.0f}} MWh/year', annual_energy_mwh) AS annual_energy_text,
         format('{{:,.1f}}', turbines) AS turbines_text, format('£{{:,.1f}}m/year', annual_revenue / 1e6) AS annual_revenue_text,
         format('£{{:,.2f}}bn', total_capex / 1e9) AS total_capex_text, format('{{:,.1f}} years', simple_payback) AS simple_payback_text,
         format('£{{:,.2f}}bn', lifetime_revenue / 1e9) AS lifetime_revenue_text,
         format('{{:,.0f}} tonnes CO₂e/year', annual_carbon_t) AS annual_carbon_text,
         format('{{:,.0f}} tonnes CO₂e', lifetime_carbon_t) AS lifetime_carbon_text
        FROM ({_model("offshore", "ref_id, site_name, capacity_mw", _DEFAULTS)})"""
    ),
    "offshore_sensitivity": _q(
        f"""SELECT ref_id, site_name, capacity_factor, annual_energy_mwh, annual_revenue / 1e6 AS annual_revenue_m, simple_payback
        FROM ({_model(
            "(SELECT * FROM offshore, (SELECT unnest([0.35, 0.40, 0.45, 0.50, 0.55]::DOUBLE[]) AS capacity_factor))",
            "ref_id, site_name, capacity_factor",
            {**_DEFAULTS, "capacity_factor": "capacity_factor"},
        )})"""
    ),
    "offshore_scenarios": _q(
        _model(
            "(SELECT o.capacity_mw, s.* FROM offshore o JOIN checked s ON o.ref_id = s.ref_id WHERE out_of_range = '')",
            "ref_id, run, capacity_mw",
            {name: name for name in _DEFAULTS},
        )
    ).replace("WITH ", f"WITH {_SCENARIOS}, ", 1),
    "scenario_check": f"WITH {_SCENARIOS} SELECT *, out_of_range = '' AS valid FROM checked",
    "project_details": _q(_DETAILS),
    "project_headlines": _q(
        """SELECT ref_id, site_name, coalesce(technology, 'N/A') AS technology_text,
         format('{:,.1f} MW', capacity_mw) AS capacity_text, coalesce(status, 'N/A') AS status_text,
         concat(score, '/100') AS score_text FROM named"""
    ),
    "project_briefs": _q(
        f"""SELECT site_name, translate(site_name, '/\\: ', '---_') || '_project_brief.txt' AS file_name,
         {_brief()} AS brief FROM named"""
    ),
    "export_filtered": _q(
        f"SELECT {_CLEAN_COLUMNS}, lon, lat, score FROM located WHERE region = 'EUROPE' AND contains({_HAYSTACK}, 'power')",
        located=True,
    ),
    "register_csv": _q(f"SELECT {_CLEAN_COLUMNS} FROM projects"),
    "register_short_rows": _q(f"SELECT {_CLEAN_COLUMNS} FROM projects").replace(
        _RAW,
        f"""SELECT * REPLACE (CASE WHEN ref_id % 249 = 0 THEN repeat('Consortium "x", ', 400) ELSE operator END AS operator,
          CASE WHEN ref_id % 3 <> 0 THEN last_updated_raw END AS last_updated_raw) FROM ({_RAW})""",
    ),
    "register_order": f"""WITH raw AS ({_RAW.strip()}), ends AS (SELECT max(ref_id) AS last FROM raw)
        SELECT row_number() OVER (ORDER BY CASE WHEN ref_id <= floor(last * 0.02::DOUBLE) THEN 4 WHEN ref_id <= floor(last * 0.6::DOUBLE) THEN 3
          WHEN ref_id <= floor(last * 0.61::DOUBLE) THEN 2 ELSE 1 END, ref_id) - 1 AS place, site_name, planning_ref, capacity_raw
        FROM raw, ends""",
    "deliveries_landed": _q(
        """SELECT places.place AS ref_id, site_name, planning_ref, capacity_mw, score
        FROM projects JOIN (
         SELECT ref_id, row_number() OVER (ORDER BY ref_id <= (SELECT max(ref_id) FROM raw) // 2, ref_id) - 1 AS place FROM raw
        ) places USING (ref_id)"""
    ),
    "deliveries_kpis": _q(_KPIS),
    "landed_projects": _q(f"SELECT ref_id, {_CLEAN_COLUMNS}, lon, lat, score FROM located", located=True),
    "briefs_written": _q(
        f"""SELECT site_name, translate(site_name, '/\\: ', '---_') || '_project_brief.txt' AS file_name, {_brief()} AS brief
        FROM (SELECT * REPLACE (site_name || ' ' || ['a/b', 'c\\d', 'e:f', 'g h/\\:'][ref_id % 4 + 1] AS site_name) FROM named)"""
    ),
    "number_texts": """SELECT o_orderkey, CAST(o_totalprice * ([1e0, 1e-9, -1e-8, 1e3, 1e11, -1e12, 1e290, 0e0]::DOUBLE[])[o_orderkey % 8 + 1] AS VARCHAR)
        AS text FROM orders""",
}
