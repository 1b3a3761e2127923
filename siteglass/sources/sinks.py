"""Writing: registers and exports as CSV, briefs as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.functions.columns import present
from siteglass.schema import CSV_HEADERS, EXPORT_HEADERS, TYPED_COLUMNS

_DERIVED = ("lon", "lat", "last_updated", "score")


def write_register_csv(raw: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write raw rows as the register is delivered: Latin-1 CSV under its headers."""
    columns = [F.col(name).alias(header) for name, header in CSV_HEADERS.items() if name in raw.columns]
    _write_csv(raw.select(*columns), path, mode, "ISO-8859-1")


def _write_csv(df: DataFrame, path: str, mode: str, encoding: str) -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("encoding", encoding)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write every row and column as UTF-8 CSV part files under register headers.

    Derived columns come last. ``ref_id`` is the engine's own and stays out. Missing
    cells are empty.
    """
    names = [name for name in df.columns if name not in ("ref_id", *_DERIVED)] + present(df, _DERIVED)
    columns = [F.col(f"`{name}`").alias(EXPORT_HEADERS.get(name, name)) for name in names]
    _write_csv(df.select(*columns), path, mode, "UTF-8")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Read an export back under engine names and types."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {header: name for name, header in EXPORT_HEADERS.items() if not name.endswith("_raw")}
    names[EXPORT_HEADERS["last_updated_raw"]] = "last_updated_raw"
    columns = []
    for header in raw.columns:
        name = names.get(header, header)
        columns.append(F.col(f"`{header}`").cast(TYPED_COLUMNS.get(name, "string")).alias(name))
    return raw.select(*columns)


def write_briefs(briefs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (site_name, file_name, brief) as Parquet, in parallel."""
    briefs.select("site_name", "file_name", "brief").write.mode(mode).parquet(path)


def read_briefs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("site_name string, file_name string, brief string").parquet(path)
