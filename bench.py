"""Times the load and every operator; prints one JSON line.

The register is written once as Latin-1 CSV (not timed). ``load`` then reads, cleans,
locates, scores and lands it as Parquet, and the operators run on the landed table.
Each figure is the median of warm runs, to completion, results discarded; ``spread`` is the
difference between the slowest and the fastest of them.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

import siteglass as sg
from siteglass.plans.queries import ON_LOCATED, ON_PROJECTS
from siteglass.sources.tables import projects_raw

RUNS = 5


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siteglass-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def median(action) -> tuple[float, float]:
    """Median and spread of warm runs."""
    action()
    runs = [timed(action) for _ in range(RUNS)]
    return round(statistics.median(runs), 3), round(max(runs) - min(runs), 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    work = tempfile.mkdtemp(prefix="siteglass-bench-")
    parts = int(cpus) if cpus.isdigit() else 8
    sg.write_register_csv(projects_raw(spark, sf_dir).repartition(parts), f"{work}/register")

    def load():
        sg.write_projects(sg.prepare(sg.read_register(spark, f"{work}/register")), f"{work}/projects", mode="overwrite")

    figures = {"load": median(load)}
    projects = sg.read_projects(spark, f"{work}/projects")
    for name, plan in {**ON_PROJECTS, **ON_LOCATED}.items():
        figures[name] = median(lambda: run(plan(projects)))
    exports = iter(range(RUNS + 1))
    figures["export_csv"] = median(lambda: sg.export_csv(projects, f"{work}/export-{next(exports)}"))
    print(
        json.dumps(
            {
                "metric": "total_seconds_all_operators",
                "value": round(sum(middle for middle, _ in figures.values()), 3),
                "unit": "sec",
                "queries": {name: middle for name, (middle, _) in figures.items()},
                "spread": {name: spread for name, (_, spread) in figures.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rows": projects.count(),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
