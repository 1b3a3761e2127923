"""Per-project details, headline texts and briefs as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions.columns import column_or_null
from siteglass.functions.text import amount_text, or_not_available, plain_number, safe_filename

# Labels of the details table and the column behind each.
DETAIL_FIELDS = (
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

# Layout of a brief. Braces name columns.
BRIEF_LINES = (
    "",
    "Renewable Project Brief",
    "=======================",
    "",
    "Project: {site_name}",
    "",
    "1. Project Overview",
    "-------------------",
    "Technology: {technology}",
    "Installed Capacity: {capacity_mw} MW",
    "Development Status: {status}",
    "Screening Score: {score}/100",
    "",
    "2. Developer and Location",
    "-------------------------",
    "Operator / Applicant: {operator}",
    "Region: {region}",
    "County: {county}",
    "Country: {country}",
    "",
    "3. Planning Information",
    "-----------------------",
    "Planning Authority: {planning_authority}",
    "Planning Application Reference: {planning_ref}",
    "Planning Submitted: {planning_submitted}",
    "Planning Granted: {planning_granted}",
    "Operational Date: {operational_date}",
    "",
    "4. Interpretation",
    "-----------------",
)
# What the score adds up to; the largest share of each part is that of ``functions/scoring.py``.
BRIEF_NOTE = (
    "Points out of 100: capacity up to 35, development stage up to 35, technology",
    "up to 20, and 2 for each of five register fields that is filled in.",
    "",
)
BRIEF_SUFFIX = "_project_brief.txt"


def _cell(df: DataFrame, name: str):
    value = column_or_null(df, name)
    if name == "capacity_mw":
        value = plain_number(value)
    return or_not_available(value.cast("string"))


def project_details(df: DataFrame) -> DataFrame:
    """Nine (field, value) rows per project."""
    pairs = [
        F.struct(F.lit(label).alias("field"), _cell(df, name).alias("value"))
        for label, name in DETAIL_FIELDS
    ]
    return df.select("ref_id", "site_name", F.inline(F.array(*pairs)))


def project_headlines(df: DataFrame) -> DataFrame:
    """The four headline texts shown above a project's details."""
    return df.select(
        "ref_id",
        "site_name",
        _cell(df, "technology").alias("technology_text"),
        amount_text(F.col("capacity_mw"), 1, after=" MW").alias("capacity_text"),
        _cell(df, "status").alias("status_text"),
        F.concat(F.col("score").cast("string"), F.lit("/100")).alias("score_text"),
    )


def project_briefs(df: DataFrame, note: tuple[str, ...] = BRIEF_NOTE) -> DataFrame:
    """A text brief and a file name for every project of ``df``.

    Give it ``first_by_name(df)`` for one brief per site name.
    """
    pieces = []
    for piece in "\n".join(BRIEF_LINES).split("{"):
        name, closed, rest = piece.partition("}")
        if closed:
            pieces += [_cell(df, name), F.lit(rest)]
        else:
            pieces.append(F.lit(piece))
    pieces.append(F.lit("\n" + "\n".join(note)))
    return df.select(
        "site_name",
        F.concat(safe_filename(F.col("site_name")), F.lit(BRIEF_SUFFIX)).alias("file_name"),
        F.concat(*pieces).alias("brief"),
    )
