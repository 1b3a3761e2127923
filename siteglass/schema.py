"""Names of the register's columns and the texts that stand for a missing cell."""

# Engine column -> header in the register CSV. The two spaces in
# "Planning Permission  Granted" are in the published file.
CSV_HEADERS = {
    "site_name": "Site Name",
    "operator": "Operator (or Applicant)",
    "technology": "Technology Type",
    "capacity_raw": "Installed Capacity (MWelec)",
    "status": "Development Status (short)",
    "region": "Region",
    "county": "County",
    "country": "Country",
    "planning_authority": "Planning Authority",
    "planning_ref": "Planning Application Reference",
    "planning_submitted": "Planning Application Submitted",
    "planning_granted": "Planning Permission  Granted",
    "operational_date": "Operational",
    "x_raw": "X-coordinate",
    "y_raw": "Y-coordinate",
    "last_updated_raw": "Record Last Updated (dd/mm/yyyy)",
}

# Headers that an export writes for typed and derived columns.
EXPORT_HEADERS = {name: header for name, header in CSV_HEADERS.items()} | {
    "capacity_mw": "Installed Capacity (MWelec)",
    "x": "X-coordinate",
    "y": "Y-coordinate",
    "lon": "Longitude",
    "lat": "Latitude",
    "last_updated": "Record Last Updated Parsed",
    "score": "Screening Score",
}

# Types of the columns that are not text.
TYPED_COLUMNS = {
    "ref_id": "bigint",
    "capacity_mw": "double",
    "x": "double",
    "y": "double",
    "lon": "double",
    "lat": "double",
    "last_updated": "date",
    "score": "int",
}

# A register without these cannot be screened.
REQUIRED_COLUMNS = (
    "site_name",
    "technology",
    "capacity_raw",
    "status",
    "region",
    "x_raw",
    "y_raw",
)

# Columns the free-text search reads, in the order they are joined.
SEARCH_COLUMNS = (
    "site_name",
    "operator",
    "technology",
    "status",
    "region",
    "county",
    "planning_authority",
    "planning_ref",
)

# Columns that count towards completeness in the screening score.
COMPLETENESS_COLUMNS = ("operator", "region", "county", "planning_authority", "planning_ref")

# Cell texts that pandas' CSV reader documents as missing.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
