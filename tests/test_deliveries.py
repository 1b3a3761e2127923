"""Deliveries landed one after the other, and the groups kept with them."""

import pytest

import siteglass as sg
from siteglass.schema import CSV_HEADERS
from siteglass.streaming import deliveries
from tests.test_ingest import HEADER, csv_line, write_csv


def lines(first, n):
    for i in range(first, first + n):
        yield csv_line(
            site_name=f"s{i % 7}", technology="AB"[i % 2], capacity_raw="TBC" if i % 5 == 0 else f"{i / 10}", region="xyz"[i % 3],
            status="Operational", last_updated_raw=f"{i % 28 + 1}/02/2024",
        )


FILES = {"a one.csv": (0, 30), "b.csv": (30, 0), "c.csv": (30, 45), "d.csv": (75, 5)}


def deliver(folder, *names):
    for name in names:
        write_csv(folder / name, "\n".join([HEADER, *lines(*FILES[name])]) + "\n")


@pytest.fixture(scope="module")
def at_once(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("once")
    deliver(path / "in", *FILES)
    sg.land_deliveries(spark, str(path / "in"), str(path / "out"))
    return sg.read_landed(spark, str(path / "out"))


def figures(df):
    return sorted(map(tuple, df.collect()), key=repr)


def check(spark, target, at_once):
    landed = sg.read_landed(spark, target)
    assert figures(landed) == figures(at_once) and landed.columns == at_once.columns
    groups = sg.kept_groups(spark, target)
    assert figures(groups) == figures(sg.capacity_groups(at_once).select(*groups.columns))
    assert sg.group_kpis(groups).collect() == sg.kpis(at_once).collect()
    assert sg.capacity_by(groups, "region").collect() == sg.capacity_by(at_once, "region").collect()


def test_one_delivery_reads_like_the_files(spark, tmp_path, at_once):
    deliver(tmp_path / "in", *FILES)
    whole = sg.prepare(sg.read_register(spark, str(tmp_path / "in")))
    assert figures(at_once) == figures(whole) and at_once.count() == 64


def test_two_deliveries_and_restarts(spark, tmp_path, at_once):
    source, target = tmp_path / "in", str(tmp_path / "out")
    deliver(source, "a one.csv", "b.csv")
    sg.land_deliveries(spark, str(source), target)
    assert sg.read_landed(spark, target).count() == 24
    deliver(source, "c.csv", "d.csv")
    for _ in range(2):  # the second time there is nothing to do
        sg.land_deliveries(spark, str(source), target)
        check(spark, target, at_once)
    entries = sg.deliveries(spark, target).orderBy("delivery").collect()
    assert [(r.first_ref_id, r.rows, len(r.files)) for r in entries] == [(0, 30, 2), (30, 50, 2)]


def test_files_one_at_a_time(spark, tmp_path, at_once):
    import os

    source, target = tmp_path / "in", str(tmp_path / "out")
    for k, name in enumerate(FILES):
        deliver(source, name)
        os.utime(source / name, (1_700_000_000 + 10 * k,) * 2)
    sg.land_deliveries(spark, str(source), target, files_at_once=1)
    assert sg.deliveries(spark, target).count() == 4
    check(spark, target, at_once)


@pytest.mark.parametrize("step", ["write_projects", "capacity_groups"])
def test_a_delivery_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch, at_once, step):
    source, target = tmp_path / "in", str(tmp_path / "out")
    deliver(source, "a one.csv", "b.csv")
    sg.land_deliveries(spark, str(source), target)
    deliver(source, "c.csv", "d.csv")
    done = getattr(deliveries, step)

    def broken(*args, **kwargs):
        done(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(deliveries, step, broken)
    with pytest.raises(Exception, match="lost"):
        sg.land_deliveries(spark, str(source), target)
    assert sg.read_landed(spark, target).count() == 24  # what it left doesn't count
    monkeypatch.setattr(deliveries, step, done)
    sg.land_deliveries(spark, str(source), target)
    check(spark, target, at_once)


def test_columns_that_come_later_and_own_numbers(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    write_csv(source / "a.csv", HEADER + ",Ref ID\n" + csv_line(site_name="A", capacity_raw="1") + ",70\n")
    sg.land_deliveries(spark, str(source), target, key="Ref ID")
    write_csv(source / "b.csv", HEADER + ",Ref ID,Note\n" + csv_line(site_name="B", capacity_raw="2") + ",7,new\n")
    sg.land_deliveries(spark, str(source), target, key="Ref ID")
    found = sg.read_landed(spark, target)
    assert sorted((r.ref_id, r.site_name, r.Note) for r in found.collect()) == [(7, "B", "new"), (70, "A", None)]
    assert {*CSV_HEADERS, "Ref ID", "Note", "score"} - {*found.columns} == {"capacity_raw", "x_raw", "y_raw"}


def test_nothing_landed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sg.land_deliveries(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sg.deliveries(spark, str(tmp_path / "out")).collect() == []
    for read in (sg.read_landed, sg.kept_groups):
        with pytest.raises(ValueError, match="nothing has been landed"):
            read(spark, str(tmp_path / "out"))
