"""Cleaning, source, landing and export."""

import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import siteglass as sg
from siteglass.functions import cleaning
from siteglass.schema import CSV_HEADERS, MISSING_TOKENS
from tests.rows import raw_frame, raw_row

NUMBERS = {
    "1000": 1000.0,
    "999.9": 999.9,
    " 5 ": 5.0,
    "\t7\t": 7.0,
    "-3": -3.0,
    "+4.": 4.0,
    ".5": 0.5,
    "1e3": 1000.0,
    "inf": float("inf"),
    "-Infinity": float("-inf"),
    "1,200.5": None,
    "": None,
    "TBC": None,
    "N/A": None,
    "NaN": None,
    "5d": None,
    "5f": None,
    "0x10": None,
    "1_000": None,
    ".": None,
    "1e": None,
    None: None,
}

DAYS = {
    "31/12/2024": datetime.date(2024, 12, 31),
    "1/2/2024": datetime.date(2024, 2, 1),
    "29/02/2024": datetime.date(2024, 2, 29),
    "31/02/2024": None,
    "12/31/2024": None,
    "2024-02-01": None,
    "01/06/24": None,
    "": None,
    "soon": None,
    None: None,
}


def column_values(spark, cells, convert):
    df = spark.createDataFrame([(i, cell) for i, cell in enumerate(cells)], "i int, cell string")
    return [row[0] for row in df.orderBy("i").select(convert(F.col("cell"))).collect()]


def test_numbers(spark):
    assert column_values(spark, NUMBERS, cleaning.to_number) == list(NUMBERS.values())


def test_days(spark):
    assert column_values(spark, DAYS, cleaning.to_day) == list(DAYS.values())


def test_filled_cells(spark):
    cells = {"a": True, " a ": True, "": False, "  ": False, " ": False, "\t\n": False, "\x1c": False, None: False}
    assert column_values(spark, cells, cleaning.is_filled) == list(cells.values())


def test_missing_tokens_become_null(spark):
    rows = [raw_row(i, capacity_raw="1", operator=token) for i, token in enumerate([*MISSING_TOKENS, "  ", "na", "Nil"])]
    kept = [row.operator for row in sg.clean(raw_frame(spark, rows)).orderBy("ref_id").collect()]
    assert kept == [None] * len(MISSING_TOKENS) + ["  ", "na", "Nil"]


def test_rows_without_capacity_go_and_half_coordinates_stay(spark):
    rows = [
        raw_row(1, capacity_raw="1,200.5", x_raw="1", y_raw="1"),
        raw_row(2, capacity_raw=None),
        raw_row(3, capacity_raw="12", x_raw="530000", y_raw=None),
        raw_row(4, capacity_raw="12", x_raw="530000", y_raw="180000"),
        raw_row(5, capacity_raw="12", x_raw="1e300", y_raw="180000"),
    ]
    df = sg.prepare(raw_frame(spark, rows))
    assert {row.ref_id: row.lat is not None for row in df.collect()} == {3: False, 4: True, 5: False}
    assert [row.ref_id for row in sg.map_points(df).collect()] == [4]


# Published test points: easting, northing, latitude, longitude.
GOLDEN = [
    (651409.903, 313177.270, 52.657979, 1.716052),
    (530000.0, 180000.0, 51.503991, -0.128354),
    (300000.0, 700000.0, 56.182100, -3.612595),
    (180000.0, 30000.0, 50.129196, -5.079524),
]


def test_coordinates(spark):
    df = sg.with_lat_lon(spark.createDataFrame(GOLDEN, "x double, y double, e_lat double, e_lon double"))
    for row in df.collect():
        assert round(row.lat, 6) == row.e_lat and round(row.lon, 6) == row.e_lon


def test_coordinate_conditions_do_not_copy_the_chain(spark):
    df = sg.with_lat_lon(spark.createDataFrame(GOLDEN, "x double, y double, e_lat double, e_lon double"))
    kept = df.where("lat > 52 AND lon < 0 AND e_lat > 0")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    assert kept.count() == 1


def write_csv(path: Path, text: str, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def csv_line(**cells):
    return ",".join(cells.get(name, "") for name in CSV_HEADERS)


HEADER = ",".join(CSV_HEADERS.values())


def test_register_file(spark, tmp_path):
    lines = [
        HEADER + ",Ref ID",
        csv_line(site_name='"Dogger ""A"", north\nbank"', capacity_raw="1200", operator="Café £", last_updated_raw="31/12/2024") + ",77",
        csv_line(site_name="Second", capacity_raw="TBC") + ",78",
        csv_line(site_name="Third", capacity_raw="  20 ", operator="N/A") + ",79",
    ]
    write_csv(tmp_path / "register.csv", "\n".join(lines) + "\n")
    raw = sg.read_register(spark, str(tmp_path / "register.csv"))
    assert raw.columns == ["ref_id", *CSV_HEADERS, "Ref ID"]
    rows = sg.prepare(raw).orderBy("ref_id").collect()
    assert [row.site_name for row in rows] == ['Dogger "A", north\nbank', "Third"]
    assert rows[0].operator == "Café £" and rows[1].operator is None
    assert rows[0].last_updated == datetime.date(2024, 12, 31)
    assert [row["Ref ID"] for row in rows] == ["77", "79"]
    assert [row.capacity_mw for row in rows] == [1200.0, 20.0]


def test_register_can_be_queried_before_it_lands(spark, tmp_path):
    lines = [HEADER] + [csv_line(site_name=f"s{i}", capacity_raw=str(i), region="AB"[i % 2]) for i in range(10)]
    write_csv(tmp_path / "in" / "a.csv", "\n".join(lines) + "\n")
    write_csv(tmp_path / "in" / "b.csv", "\n".join(lines) + "\n")
    for multi_line in (True, False):
        df = sg.clean(sg.read_register(spark, str(tmp_path / "in"), multi_line=multi_line))
        assert [tuple(row) for row in sg.capacity_by(df, "region").collect()] == [("B", 50.0), ("A", 40.0)]
        assert df.count() == 20


def test_register_without_optional_columns(spark, tmp_path):
    write_csv(
        tmp_path / "r.csv",
        "Site Name,Technology Type,Installed Capacity (MWelec),Development Status (short),Region,X-coordinate,Y-coordinate\n"
        "A,Solar,50,Operational,East,530000,180000\n",
    )
    df = sg.prepare(sg.read_register(spark, str(tmp_path / "r.csv")))
    row = df.collect()[0]
    assert row.score == 12 + 35 + 15 + 2
    assert sg.dataset_summary(df).collect()[0].latest_update_text == "N/A"
    assert [r.score for r in sg.search(df, "solar operational").collect()] == [row.score]
    assert {r.value for r in sg.project_details(df).collect()} == {"East", "N/A"}
    assert sg.preview(df).columns == ["site_name", "technology", "capacity_mw", "status", "region", "score"]


def test_register_order_over_files(spark, tmp_path):
    # Sizes that make Spark read the last file first.
    for file, count in (("a one.csv", 2), ("b.csv", 40), ("c.csv", 300)):
        lines = [HEADER] + [csv_line(site_name=f"{file[0]}{i:03d}", capacity_raw="1") for i in range(count)]
        write_csv(tmp_path / "in" / file, "\n".join(lines) + "\n")
    for multi_line in (True, False):
        raw = sg.read_register(spark, str(tmp_path / "in"), multi_line=multi_line)
        names = [row.site_name for row in raw.orderBy("ref_id").collect()]
        assert names == sorted(names) and len(names) == 342
        assert raw.select("ref_id").distinct().count() == 342


def test_register_order_over_splits(spark, tmp_path, settings):
    settings(files__maxPartitionBytes="2000", files__openCostInBytes="0")
    for file, count in (("a.csv", 200), ("b.csv", 350)):
        lines = [HEADER] + [csv_line(site_name=f"{file[0]}{i:03d}", capacity_raw="1") for i in range(count)]
        write_csv(tmp_path / "in" / file, "\n".join(lines) + "\n")
    raw = sg.read_register(spark, str(tmp_path / "in"), multi_line=False)
    assert raw.rdd.getNumPartitions() > 4
    names = [row.site_name for row in raw.orderBy("ref_id").collect()]
    assert names == sorted(names) and len(names) == 550


@pytest.mark.parametrize("size", ["700", "5000", "128m"])
@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_register_order_does_not_depend_on_splits_or_files(spark, tmp_path, settings, monkeypatch, size, broadcast):
    monkeypatch.setattr("siteglass.sources.register._BROADCAST_SPLITS", broadcast)
    settings(files__maxPartitionBytes=size, files__openCostInBytes="0")
    expected = []
    for file in range(40):
        count = (7 * file) % 23 + (150 if file == 3 else 0)
        lines = [HEADER] + [csv_line(site_name=f"f{file:02d}-{i:03d}", capacity_raw="1") for i in range(count)]
        write_csv(tmp_path / "in" / f"{file:02d}.csv", "\n".join(lines) + "\n")
        expected += [f"f{file:02d}-{i:03d}" for i in range(count)]
    raw = sg.read_register(spark, str(tmp_path / "in"), multi_line=False)
    assert [tuple(r) for r in raw.select("ref_id", "site_name").orderBy("ref_id").collect()] == list(enumerate(expected))


def test_register_key(spark, tmp_path):
    lines = [HEADER + ",Ref ID"] + [csv_line(site_name=f"s{i}", capacity_raw="1") + f",{90 - i}" for i in range(3)]
    write_csv(tmp_path / "r.csv", "\n".join(lines) + "\n")
    raw = sg.read_register(spark, str(tmp_path / "r.csv"), key="Ref ID")
    assert [(row.ref_id, row.site_name) for row in raw.orderBy("ref_id").collect()] == [(88, "s2"), (89, "s1"), (90, "s0")]


def test_files_with_other_headers_stop(spark, tmp_path):
    write_csv(tmp_path / "in" / "a.csv", HEADER + "\n" + csv_line(site_name="A", capacity_raw="1") + "\n")
    other = ",".join(reversed(HEADER.split(",")))
    write_csv(tmp_path / "in" / "b.csv", other + "\n" + csv_line(site_name="B", capacity_raw="1") + "\n")
    for multi_line in (True, False):
        with pytest.raises(Exception, match="header"):
            sg.read_register(spark, str(tmp_path / "in"), multi_line=multi_line).collect()


@pytest.mark.parametrize("multi_line", [True, False])
def test_short_records_are_filled_and_long_ones_stop(spark, tmp_path, multi_line):
    line = csv_line(site_name='"A, ""x"" b"', capacity_raw="1", technology="T")
    short = ['"S, ""1"", 2",Op', "T", "", line]
    write_csv(tmp_path / "in" / "a.csv", "\n".join([HEADER, *short]) + "\n")
    write_csv(tmp_path / "in" / "b.csv", HEADER + "\n" + line + "\n")
    raw = sg.read_register(spark, str(tmp_path / "in"), multi_line=multi_line)
    assert [(r.ref_id, r.site_name, r.operator) for r in raw.orderBy("ref_id").collect()] == [
        (0, 'S, "1", 2', "Op"), (1, "T", None), (2, 'A, "x" b', None), (3, 'A, "x" b', None)
    ]
    assert raw.count() == 4 and raw.select("region").distinct().count() == 1
    for extra in (",", ",,one", ",one,too,many", ',"a,b"'):
        write_csv(tmp_path / "in" / "b.csv", "\n".join([HEADER, line, line + extra]) + "\n")
        raw = sg.read_register(spark, str(tmp_path / "in"), multi_line=multi_line)
        for read in (raw, raw.select("site_name"), raw.select("ref_id"), sg.clean(raw).select("capacity_mw")):
            with pytest.raises(Exception, match=r"more cells than the header: \"A, \"\"x"):
                read.collect()
        with pytest.raises(Exception, match="more cells than the header"):
            raw.count()


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("size", [5_000, 1_000_000])
def test_quoted_cells_of_any_length(spark, tmp_path, multi_line, size):
    """In a record of the right length, in a short one, and in a long one, which stops with its text."""
    cell = '"' + ('x,"",' * size)[: size - size % 5] + '"'
    whole, short = csv_line(site_name=cell, capacity_raw="1"), cell + ",Op"
    write_csv(tmp_path / "in" / "a.csv", "\n".join([HEADER, whole, short, "T"]) + "\n")
    rows = sg.read_register(spark, str(tmp_path / "in"), multi_line=multi_line).orderBy("ref_id").collect()
    text = cell[1:-1].replace('""', '"')
    assert [(r.site_name, r.operator) for r in rows] == [(text, None), (text, "Op"), ("T", None)]
    write_csv(tmp_path / "in" / "b.csv", "\n".join([HEADER, whole + ",one"]) + "\n")
    with pytest.raises(Exception, match="more cells than the header"):
        sg.read_register(spark, str(tmp_path / "in"), multi_line=multi_line).collect()


def test_broken_register_stops(spark, tmp_path):
    write_csv(tmp_path / "r.csv", HEADER + "\n" + csv_line(site_name="A", capacity_raw="1") + ",one,too,many\n")
    with pytest.raises(Exception, match="more cells than the header: A,"):
        sg.read_register(spark, str(tmp_path / "r.csv")).collect()
    write_csv(tmp_path / "s.csv", "Site Name,Region\nA,B\n")
    with pytest.raises(ValueError, match="Technology Type"):
        sg.read_register(spark, str(tmp_path / "s.csv"))
    with pytest.raises(PySparkException):
        sg.read_register(spark, str(tmp_path / "absent.csv"))


def test_landing_round_trip(spark, tmp_path):
    df = sg.prepare(raw_frame(spark, [raw_row(i, capacity_raw=str(i), technology="AB"[i % 2]) for i in range(20)]))
    sg.write_projects(df, str(tmp_path / "projects"))
    back = sg.read_projects(spark, str(tmp_path / "projects"))
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    plan = back.where("technology = 'A'").select("capacity_mw")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(technology,A)" in plan and "ReadSchema: struct<technology:string,capacity_mw:double>" in plan


def test_export_round_trip(spark, tmp_path):
    rows = [
        raw_row(1, site_name='q"uo,te\nline', operator="  ", technology="Solar", capacity_raw="12.5", status="Operational",
                x_raw="530000", y_raw="180000", last_updated_raw="31/12/2024"),
        raw_row(2, site_name=" lead and trail ", county="£é€\\ back", capacity_raw="1e-5", last_updated_raw="bad"),
        raw_row(3, site_name="carriage\rreturn", capacity_raw="inf"),
    ]
    df = sg.prepare(raw_frame(spark, rows))
    sg.export_csv(df, str(tmp_path / "out"))
    back = sg.read_export(spark, str(tmp_path / "out"))
    assert back.columns[-4:] == ["lon", "lat", "last_updated", "score"]
    assert sorted(back.collect(), key=str) == sorted(df.select(*back.columns).collect(), key=str)
    assert set(back.columns) == set(df.columns) - {"ref_id"}
    text = "".join(file.read_text(encoding="utf-8", newline="") for file in (tmp_path / "out").glob("*.csv"))
    assert text.startswith("Site Name,Operator (or Applicant),Technology Type,Installed Capacity (MWelec),")
    assert "Planning Permission  Granted" in text and "Screening Score" in text
