"""The register CSV as a source, and its landed Parquet form."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteglass.schema import CSV_HEADERS, REQUIRED_COLUMNS

# Where Spark puts the text of a record whose length differs from the header's.
_RECORD = "_record_of_other_length"
# Up to this many splits their places are sent to every task.
_BROADCAST_SPLITS = 500_000
# What exact filters choose by; up to this many combinations of it are sent to every task.
_CHOICES = ("technology", "status", "region")
_BROADCAST_CHOICES = 100_000
# Bits of a rank among the values of a column.
_BITS = 16
_PLACE = "_place"
_ROW_GROUP_BYTES = 32 << 20


def read_register(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "ISO-8859-1",
    multi_line: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Raw register rows: every cell as text, columns under their engine names.

    Columns are found by header; unknown ones are kept under their own header. All
    files must have the same one. Cells may hold line breaks, which makes a file
    unsplittable; for large files without such cells pass ``multi_line=False``, or
    deliver the register in many files.

    ``ref_id`` is the whole number in column ``key`` if one is named. Otherwise it is
    the place in the register, counted from 0: file by path, then row. It takes a second
    reading of the files, for the number of rows in each split, and is stored when
    the projects are landed.

    A record with too few cells is filled with NULL. One with too many stops the read
    with its text.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
    )
    headers = reader.csv(path).columns
    engine_names = {header: name for name, header in CSV_HEADERS.items()}
    names = [engine_names.get(header, header) for header in headers]
    absent = [CSV_HEADERS[name] for name in REQUIRED_COLUMNS if name not in names]
    if absent:
        raise ValueError(f"the register lacks the columns {absent}")
    cells = T.StructType([T.StructField(header, T.StringType()) for header in headers])
    # Only a parser that reads whole records notices their length.
    raw = (
        reader.option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _RECORD)
        .schema(T.StructType([*cells, T.StructField(_RECORD, T.StringType())]))
        .csv(path)
    )
    columns = [F.col(f"`{header}`").alias(name) for header, name in zip(headers, names)]
    if key is not None:
        return raw.where(_not_too_long(headers)).select(F.col(f"`{key}`").cast("bigint").alias("ref_id"), *columns)
    split = ["_file", "_block"]
    places = _split_places(_with_sequence(reader.schema(cells).csv(path), []))
    # Every split is in one task, and a task takes only so many of them.
    in_a_task = _bytes(spark, "maxPartitionBytes") // max(1, _bytes(spark, "openCostInBytes")) + 1
    if raw.rdd.getNumPartitions() * in_a_task <= _BROADCAST_SPLITS:
        places = F.broadcast(places)
    numbered = _with_sequence(raw, [*columns, _not_too_long(headers).alias("_fits")]).where("_fits").join(places, split)
    ref_id = F.col("_before") + F.col("_sequence") - F.col("_first")
    return numbered.select(ref_id.alias("ref_id"), *[f"`{name}`" for name in names])


def _bytes(spark: SparkSession, setting: str) -> int:
    text = spark.conf.get(f"spark.sql.files.{setting}").strip().lower().rstrip("b")
    return int(text[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[text[-1]] if text[-1].isalpha() else int(text)


def _with_sequence(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows with file, place of their split in it, and a number that rises by 1 within a split."""
    return rows.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_sequence"),
    )


def _split_places(rows: DataFrame) -> DataFrame:
    """For each split the number of its first row, and how many rows of the register come before it.

    One small row per split: the running sum is over these, not over the register.
    """
    splits = rows.groupBy("_file", "_block").agg(F.min("_sequence").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("_file", "_block", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))


def _not_too_long(headers: list[str]) -> Column:
    """True, or an error with the record's text if it has more cells than the header.

    Only records of another length have their text in this column. Separators inside
    quoted cells don't count; the pattern gives nothing back (``++``, ``*+``), so a cell may be of
    any length. The first cell is named because Spark refuses to read the record's text alone.
    """
    unquoted = F.regexp_replace(_RECORD, r'(^|,)\s*+"(?:[^"]++|"")*+"', "$1")
    too_long = F.regexp_count(unquoted, F.lit(",")) + 1 > len(headers)
    message = F.concat(F.lit("this record has more cells than the header: "), F.col(_RECORD), F.left(F.coalesce(F.col(f"`{headers[0]}`"), F.lit("")), F.lit(0)))
    return F.when(F.col(_RECORD).isNotNull() & too_long, F.raise_error(message).cast("boolean")).otherwise(True)


def write_projects(
    projects: DataFrame, path: str, mode: str = "errorifexists", clustered: bool = False, row_group_bytes: int = _ROW_GROUP_BYTES
) -> None:
    """Land prepared projects as Parquet, once, for all later queries.

    Sorting inside each task, without a shuffle, keeps equal choices together so that exact filters skip row
    groups; files keep the order of the register. ``clustered`` moves every row once instead, by range over
    interleaved technology, status and region: each choice alone then skips most row groups. Either
    way a Bloom filter (or the column's dictionary) says which row groups hold a site name.
    """
    if clustered:
        laid = interleaved(projects, _CHOICES).sortWithinPartitions(_PLACE, "capacity_mw").drop(_PLACE)
    else:
        laid = projects.sortWithinPartitions("technology", "region", "status", "capacity_mw")
    (
        laid.write.mode(mode)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.bloom.filter.enabled#site_name", True)
        .option("parquet.bloom.filter.adaptive.enabled", True)
        .parquet(path)
    )


def interleaved(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` in ranges over the interleaved bits of the ranks of its values in ``names``; the place in column ``_place``.

    Ranks are taken over the distinct combinations only. Rows of one combination, however many, are
    divided by ``ref_id``.
    """
    found = df.select(*names).distinct()
    places = F.lit(0).cast("bigint")
    for k, name in enumerate(names):
        # Ranks are stretched over all bits, so that each column decides its share of the first ones.
        values = found.select(F.col(name).alias("_value")).distinct()
        rank = F.percent_rank().over(Window.orderBy("_value"))
        ranked = values.select("_value", F.floor(rank * ((1 << _BITS) - 1)).cast("bigint").alias(f"_rank{k}"))
        found = found.join(ranked, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value")
        for bit in range(_BITS):
            one = F.shiftright(f"_rank{k}", bit).bitwiseAND(F.lit(1).cast("bigint"))
            places = places + one * (1 << (bit * len(names) + k))
    found = found.select(*names, places.alias(_PLACE))
    if found.count() <= _BROADCAST_CHOICES:
        found = F.broadcast(found)
    same = reduce(and_, [F.col(f"d.{name}").eqNullSafe(F.col(f"f.{name}")) for name in names])
    return df.alias("d").join(found.alias("f"), same, "left").select("d.*", _PLACE).repartitionByRange(_PLACE, "ref_id")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
