"""The test tables seen as a raw register: one project per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("orders", "customer", "nation", "region")

# Plain SQL that Spark and DuckDB read alike. The remainders make every kind of cell
# occur: missing, blank, unreadable numbers and dates, half a coordinate.
PROJECTS_RAW_SQL = """
SELECT o.o_orderkey AS ref_id,
 CASE WHEN o.o_orderkey % 211 = 0 THEN NULL ELSE concat(c.c_name, ' site') END AS site_name,
 CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 7 = 0 THEN '  ' ELSE concat(c.c_mktsegment, ' Power') END AS operator,
 CASE o.o_orderkey % 9 WHEN 0 THEN 'Wind Offshore' WHEN 1 THEN 'Wind Onshore' WHEN 2 THEN 'Solar Photovoltaics'
   WHEN 3 THEN 'Battery' WHEN 4 THEN 'Pumped Storage' WHEN 5 THEN 'Biomass' WHEN 6 THEN 'Solar with Battery' WHEN 7 THEN 'Landfill Gas' END AS technology,
 CASE WHEN o.o_orderkey % 41 = 0 THEN NULL WHEN o.o_orderkey % 43 = 0 THEN '1,200.5' WHEN o.o_orderkey % 47 = 0 THEN 'TBC'
   ELSE concat(CAST(CAST(floor(o.o_totalprice / 400) AS BIGINT) AS STRING), '.', CAST(CAST(floor(o.o_totalprice / 40) AS BIGINT) % 10 AS STRING)) END AS capacity_raw,
 CASE o.o_orderkey % 7 WHEN 0 THEN 'Operational' WHEN 1 THEN 'Under Construction' WHEN 2 THEN 'Awaiting Construction'
   WHEN 3 THEN 'Planning Granted' WHEN 4 THEN 'Planning Submitted' WHEN 5 THEN 'Refused' END AS status,
 CASE WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE r.r_name END AS region,
 CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE n.n_name END AS county,
 concat('Country ', CAST(c.c_nationkey % 4 AS STRING)) AS country,
 CASE WHEN o.o_orderkey % 17 = 0 THEN '' ELSE concat('Authority ', CAST(c.c_custkey % 50 AS STRING)) END AS planning_authority,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE concat('REF/', CAST(o.o_orderkey AS STRING)) END AS planning_ref,
 concat('01/06/', CAST(year(o.o_orderdate) - 2 AS STRING)) AS planning_submitted,
 CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE concat('01/06/', CAST(year(o.o_orderdate) - 1 AS STRING)) END AS planning_granted,
 CASE WHEN o.o_orderkey % 7 = 0 THEN concat('01/06/', CAST(year(o.o_orderdate) AS STRING)) END AS operational_date,
 CASE WHEN o.o_orderkey % 31 = 0 THEN 'unknown' ELSE CAST(100000 + (o.o_orderkey * 7919) % 500000 AS STRING) END AS x_raw,
 CASE WHEN o.o_orderkey % 37 = 0 THEN NULL ELSE CAST(50000 + (o.o_orderkey * 10007) % 1000000 AS STRING) END AS y_raw,
 CASE WHEN o.o_orderkey % 53 = 0 THEN 'not dated' ELSE concat(lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o.o_orderdate) AS STRING)) END AS last_updated_raw
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
 JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""


_schemas: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table. Its schema is read from the footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def projects_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROJECTS_RAW_SQL, **{name: read_table(spark, sf_dir, name) for name in TABLES})
