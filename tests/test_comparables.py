"""Comparables against brute force, on data made to be awkward."""

import pickle
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from siteglass import comparables, comparables_of
from siteglass.operators.comparables import _layout, _read_in_order, _reader
from tests.rows import PROJECT_SCHEMA


def brute_force(rows, low=0.7, high=1.3, n=5):
    first = {}
    for row in sorted(rows):
        if row[1] is not None:
            first.setdefault(row[1], row)
    found = set()
    for ref, name, technology, capacity, *_ in first.values():
        band = [
            other
            for other in rows
            if technology is not None
            and other[2] == technology
            and capacity * low <= other[3] <= capacity * high
            and other[1] != name
        ]
        band.sort(key=lambda other: (-other[3], other[0]))
        for place, other in enumerate(band[:n], start=1):
            found.add((ref, name, technology, capacity, place, other[0], other[1], other[3], *other[4:]))
    return found


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, PROJECT_SCHEMA).repartition(5)
    found = [tuple(row) for row in comparables(df, **options).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_force(rows, **options)


def register(seed, size, technologies, names, capacities):
    """Rows whose fields are drawn from functions of a random generator."""
    rng = random.Random(seed)
    return [
        (i, names(rng), technologies(rng), float(capacities(rng)), f"r{i % 3}", f"s{i % 4}", i % 100)
        for i in range(size)
    ]


def mostly(hot, other):
    return lambda rng: hot if rng.random() < 0.4 else other(rng)


SHAPES = {
    "spread": (lambda r: r.choice("ABC"), lambda r: f"n{r.randrange(400)}", lambda r: round(r.lognormvariate(3, 2), 1)),
    "hot technology": (mostly("A", lambda r: r.choice("BC")), lambda r: f"n{r.randrange(300)}", lambda r: r.uniform(1, 2)),
    "hot name": (lambda r: r.choice("AB"), mostly("hot", lambda r: f"n{r.randrange(200)}"), lambda r: r.uniform(5, 9)),
    "missing names": (lambda r: "A", mostly(None, lambda r: f"n{r.randrange(100)}"), lambda r: r.randrange(20)),
    "hot capacity": (lambda r: r.choice(["A", None]), lambda r: f"n{r.randrange(300)}", mostly(10.0, lambda r: r.choice([7, 13, 9.1, 0, -3]))),
    "two names": (lambda r: "A", lambda r: r.choice("xy"), lambda r: r.uniform(1, 1.2)),
    "few of all": (lambda r: r.choice("AB"), lambda r: r.choice("vwxyz"), lambda r: r.choice([1, 2, 3, float("inf")])),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_matches_brute_force(spark, settings, shape):
    # Many small slices and batches, so that rows are carried across all of them.
    settings(adaptive__coalescePartitions__enabled="false", execution__arrow__maxRecordsPerBatch="7")
    technologies, names, capacities = SHAPES[shape]
    check(spark, register(len(shape), 900, technologies, names, capacities))


def test_one_name_fills_whole_slices(spark, settings):
    settings(adaptive__coalescePartitions__enabled="false")
    rows = [(i, "hot", "A", 100 + i / 1000, "r", "s", 1) for i in range(1, 800)]
    rows += [(1000 + i, f"n{i}", "A", 90 + i / 10, "r", "s", 2) for i in range(40)]
    rows += [(0, "hot", "A", 110.0, "r", "s", 3)]
    check(spark, rows)


def test_without_broadcast(spark, settings, monkeypatch):
    monkeypatch.setattr("siteglass.operators.comparables._BROADCAST_ROWS", 0)
    settings(adaptive__coalescePartitions__enabled="false", autoBroadcastJoinThreshold="-1")
    technologies, names, capacities = SHAPES["hot name"]
    check(spark, register(5, 500, technologies, names, capacities))


def test_band_ends_are_included(spark):
    capacity = 10.0
    rows = [(0, "a", "A", capacity, "r", "s", 1)]
    rows += [(i, f"n{i}", "A", value, "r", "s", 1) for i, value in enumerate((7.0, 13.0, 6.999999, 13.000001), 1)]
    found = {row.comparable_ref_id for row in comparables(spark.createDataFrame(rows, PROJECT_SCHEMA)).where("ref_id = 0").collect()}
    assert found == {1, 2}


def test_other_sizes(spark):
    technologies, names, capacities = SHAPES["spread"]
    check(spark, register(1, 400, technologies, names, capacities), low=0.5, high=1.0, n=2)


def test_empty_register(spark):
    assert comparables(spark.createDataFrame([], PROJECT_SCHEMA)).collect() == []


def test_plan_has_no_pairing_join(spark):
    technologies, names, capacities = SHAPES["spread"]
    df = spark.createDataFrame(register(2, 50, technologies, names, capacities), PROJECT_SCHEMA)
    plan = comparables(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rows_move_twice(spark):
    """Once by range, and what is left of each name for its first record."""
    technologies, names, capacities = SHAPES["spread"]
    df = spark.createDataFrame(register(2, 50, technologies, names, capacities), PROJECT_SCHEMA)
    plan = _layout(df, 1.3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2
    assert "Exchange rangepartitioning(technology" in plan and "Exchange hashpartitioning(site_name" in plan
    assert "row_number(), 1, Partial" in plan


def test_slices_hand_on_few_rows(spark, settings):
    settings(adaptive__coalescePartitions__enabled="false")
    for shape in ("spread", "hot technology", "hot name"):
        rows = register(3, 3000, *SHAPES[shape])
        laid = _layout(spark.createDataFrame(rows, PROJECT_SCHEMA), 1.3)
        ends = _read_in_order(laid, ["slice", "technology"], _reader(5, 0.7)).where("kind = 0").collect()
        assert 1 < len({end.slice for end in ends}) <= 8
        assert len(ends) == len({(end.slice, end.technology) for end in ends})
        assert all(1 <= len(end.rows) <= 10 for end in ends)


@pytest.mark.parametrize("shape", SHAPES)
def test_chosen_names(spark, shape):
    rows = register(len(shape) + 1, 300, *SHAPES[shape])
    df = spark.createDataFrame(rows, PROJECT_SCHEMA).repartition(3)
    whole = brute_force(rows)
    chosen = sorted({row[1] for row in rows if row[1] is not None})[:3]
    found = [tuple(row) for row in comparables_of(df, *chosen, "no such name").collect()]
    assert len(found) == len(set(found)) and set(found) == {row for row in whole if row[1] in chosen}


def test_no_chosen_name(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0, "r", "s", 1)], PROJECT_SCHEMA)
    for names in ((), ("b",), ("a",)):
        none = comparables_of(df, *names)
        assert none.collect() == [] and none.columns == comparables(df).columns


def test_workers_need_no_package(tmp_path):
    (tmp_path / "reader").write_bytes(cloudpickle.dumps(_reader(5, 0.7)))
    code = "import pickle; pickle.load(open('reader', 'rb'))(iter(())).__next__"
    subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, check=True)
    assert callable(pickle.loads((tmp_path / "reader").read_bytes()))
