"""Register deliveries that arrive over time, landed one after the other as a file stream.

Each delivery is what has arrived in the source folder since the last one. Its rows are numbered
after those landed before, prepared and written to a folder of their own, and its groups are merged into
the kept ones, from the new rows alone. The stream's checkpoint says which files belong to which delivery, so a
delivery that breaks off is done again with the same files and replaces what it left; it
counts once its entry, written last, is there.

Below the target folder: ``projects`` and ``groups`` by delivery, ``deliveries`` with one entry each, ``checkpoint``.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteglass.operators.summary import capacity_groups
from siteglass.plans.projects import prepare
from siteglass.sources.register import read_register, write_projects

_ENTRY = "delivery bigint, first_ref_id bigint, rows bigint, columns string, files array<string>"
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def land_deliveries(spark: SparkSession, source: str, target: str, files_at_once: int | None = None, **reading) -> None:
    """Land all files in the folder ``source`` that haven't been landed in ``target`` yet; returns when they are.

    New files make one delivery, or several of ``files_at_once`` files, oldest first, and are
    numbered by path within it. ``reading`` goes to :func:`read_register`; with a ``key``, rows keep their own numbers.
    Files must not change after they have arrived, and with ``multi_line`` their names can't hold the signs
    of file patterns. The driver holds the paths of one delivery.
    """

    def land(batch: DataFrame, delivery: int) -> None:
        files = sorted(row.path for row in batch.collect())
        if files:
            _land(spark, files, target, delivery, reading)

    listing = spark.readStream.format("binaryFile").schema(_FILE)  # paths only: no content is read
    if files_at_once:
        listing = listing.option("maxFilesPerTrigger", files_at_once)
    stream = (
        listing.load(source).select("path").writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    stream.awaitTermination()


def _land(spark: SparkSession, files: list[str], target: str, delivery: int, reading: dict) -> None:
    earlier = deliveries(spark, target).where(F.col("delivery") < delivery)
    last, first = earlier.agg(F.max("delivery"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # A path is a pattern to the reader; here it means itself.
    raw = read_register(spark, [re.sub(r"([][{}*?\\])", r"\\\1", path) for path in files], **reading)
    numbers = Observation()
    # The greatest number, not a count: rows that are read again after a loss change nothing.
    raw = raw.observe(numbers, F.max("ref_id").alias("last"))
    if "key" not in reading:
        raw = raw.withColumn("ref_id", F.col("ref_id") + F.lit(first))
    path = f"{target}/projects/delivery={delivery}"
    projects = prepare(raw)
    write_projects(projects, path, mode="overwrite")
    highest = numbers.get["last"]
    rows = 0 if highest is None else highest + 1
    groups = capacity_groups(spark.read.schema(projects.schema).parquet(path))
    if last is not None:
        groups = capacity_groups(spark.read.schema(groups.schema).parquet(f"{target}/groups/delivery={last}").unionByName(groups))
    groups.write.mode("overwrite").parquet(f"{target}/groups/delivery={delivery}")
    entry = spark.createDataFrame([(first, rows, projects.schema.json(), files)], _ENTRY.partition(", ")[2])
    entry.write.mode("overwrite").parquet(f"{target}/deliveries/delivery={delivery}")


def deliveries(spark: SparkSession, target: str) -> DataFrame:
    """One row for each landed delivery: its number, first ref_id, rows in its files, columns and files."""
    try:
        return spark.read.schema(_ENTRY).parquet(f"{target}/deliveries")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def read_landed(spark: SparkSession, target: str) -> DataFrame:
    """The projects of all landed deliveries; columns that a delivery lacks are NULL in its rows."""
    landed = deliveries(spark, target).select("delivery", "columns").orderBy("delivery").collect()
    if not landed:
        raise ValueError(f"nothing has been landed in {target}")
    fields = reduce(lambda seen, row: seen | {f.name: f for f in _fields(row.columns) if f.name not in seen}, landed, {})
    schema = T.StructType([*fields.values(), T.StructField("delivery", T.LongType())])
    return spark.read.schema(schema).parquet(f"{target}/projects").where(F.col("delivery") <= landed[-1].delivery).drop("delivery")


def _fields(columns: str) -> list[T.StructField]:
    return T.StructType.fromJson(json.loads(columns)).fields


def kept_groups(spark: SparkSession, target: str) -> DataFrame:
    """What :func:`capacity_groups` says of all landed deliveries, from the kept table alone."""
    last = deliveries(spark, target).agg(F.max("delivery")).first()[0]
    if last is None:
        raise ValueError(f"nothing has been landed in {target}")
    return spark.read.parquet(f"{target}/groups/delivery={last}")
