"""Which landed files can hold a match: a table of three-character strings.

Every three neighbouring characters of a row's searchable text are listed with the file the row is in, once
a file, sorted by the string. A search looks up the strings that every match must hold, reads only
the files that hold them all, and tests their rows as an ordinary search does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.operators.filters import required_texts, search, searchable_text
from siteglass.sources.register import read_projects

_SIZE = 3


def write_search_index(spark: SparkSession, projects_path: str, path: str, mode: str = "errorifexists") -> None:
    """List the strings of all landed files below ``projects_path``; a table landed anew needs a new list.

    Its size follows the number of files and the different strings in each, which combine before they move.
    """
    projects = read_projects(spark, projects_path)
    strings = F.array_distinct(F.regexp_extract_all(searchable_text(projects), F.lit(f"(?s)(?=(.{{{_SIZE}}}))"), F.lit(1)))
    held = projects.select(F.explode(strings).alias("string"), F.col("_metadata.file_path").alias("file")).distinct()
    held.repartitionByRange("string", "file").sortWithinPartitions("string", "file").write.mode(mode).parquet(path)


def files_with(index: DataFrame, texts: list[str]) -> list[str] | None:
    """The files that hold all strings of ``texts``; None if these are too short to have any."""
    strings = {t[i : i + _SIZE] for t in texts for i in range(len(t) - _SIZE + 1)}
    if not strings:
        return None
    found = index.where(F.col("string").isin(sorted(strings))).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return sorted(row.file for row in found.where(F.col("n") == len(strings)).collect())


def search_landed(spark: SparkSession, projects_path: str, index_path: str, query: str) -> DataFrame:
    """``search(read_projects(spark, projects_path), query)``, read from the files that can hold a match.

    The driver holds the paths of these files.
    """
    projects = read_projects(spark, projects_path)
    matches = search(projects, query)
    files = files_with(spark.read.parquet(index_path), required_texts(query)) if query.strip() else None
    if files is None:
        return matches
    if not files:
        return matches.limit(0)
    return search(spark.read.schema(projects.schema).parquet(*files), query)
