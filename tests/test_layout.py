"""What landed tables let a query skip: by name, by choice, by search text, by band."""

import random

import pytest
from pyspark.sql import functions as F

import siteglass as sg
from siteglass.operators.filters import required_texts
from siteglass.plans.queries import CHOSEN_NAME, projects
from tests.metrics import rows_read
from tests.rows import PROJECT_SCHEMA, raw_frame, raw_row

ROWS = 139_897


@pytest.fixture(scope="module")
def register(spark):
    return projects(spark, "/root/testdata/sf0.1").repartitionByRange(12, "ref_id").cache()


def landed(spark, folder, register, **options):
    sg.write_projects(register, str(folder), row_group_bytes=60_000, **options)
    return sg.read_projects(spark, str(folder))


@pytest.fixture(scope="module")
def plain(spark, register, tmp_path_factory):
    return landed(spark, tmp_path_factory.mktemp("plain") / "projects", register)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_name_reads_few_row_groups(spark, plain, register):
    every = rows_read(spark, lambda: plain.select("site_name", "region").collect())
    assert every == ROWS
    assert rows_read(spark, lambda: plain.where(F.col("site_name") == CHOSEN_NAME).select("ref_id", "region").collect()) < ROWS / 5
    found = []
    # Looks the name up, then reads one technology's band.
    assert rows_read(spark, lambda: found.extend(sg.comparables_of(plain, CHOSEN_NAME).collect())) < ROWS / 2
    assert len(found) == 5 and sorted(found) == sorted(sg.comparables(register).where(F.col("site_name") == CHOSEN_NAME).collect())


@pytest.mark.parametrize("choice", [{"region": "EUROPE"}, {"status": "Refused"}, {"technology": "Battery"}, {"region": "ASIA", "status": "Operational"}])
def test_each_choice_alone_skips_row_groups(spark, register, plain, tmp_path, choice):
    clustered = landed(spark, tmp_path / "clustered", register, clustered=True)
    assert rows(clustered) == rows(register) and clustered.dtypes == register.dtypes
    found = sg.apply_filters(clustered, **choice)
    share = found.count() / ROWS
    read = rows_read(spark, lambda: found.select("ref_id", "site_name").collect())
    assert read < ROWS * min(0.5, 2.5 * share + 0.05)


def test_clustering_takes_missing_values_and_one_combination(spark, tmp_path):
    data = [(i, f"n{i}", None if i % 3 else "T", float(i), None, "s" if i % 2 else None, 1) for i in range(40)]
    for k, df in enumerate((spark.createDataFrame(data, PROJECT_SCHEMA), spark.createDataFrame(data[:1] * 50, PROJECT_SCHEMA), spark.createDataFrame([], PROJECT_SCHEMA))):
        sg.write_projects(df, str(tmp_path / str(k)), clustered=True)
        assert rows(sg.read_projects(spark, str(tmp_path / str(k)))) == rows(df)


def test_one_combination_is_divided(spark, register, tmp_path, settings):
    settings(adaptive__coalescePartitions__enabled="false")
    one = register.withColumns({"technology": F.lit("T"), "status": F.lit("S"), "region": F.lit("R")})
    sg.write_projects(one, str(tmp_path / "p"), clustered=True)
    sizes = [r["count"] for r in sg.read_projects(spark, str(tmp_path / "p")).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) > 4 and max(sizes) < ROWS / 3


QUERIES = [
    "ref/13989", "REF/1498", "building power", "si", "", "  ", "nothing of that kind", "power.*(battery|storage) awaiting", r"ref/14\d+5$", "customer#00000(1|2)3",
    r"ref\/777", "a|b", "(?i)europe", "battery+", "x{2}ref", "batt?ery", "[qz]ref/12", r"authority 4[0-9] ref/1399", "europe .* authority 7 ref/10", r"\x41sia",
]


@pytest.fixture(scope="module")
def searchable(spark, register, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search"))
    sg.write_projects(register, f"{path}/projects")
    sg.write_search_index(spark, f"{path}/projects", f"{path}/strings")
    return f"{path}/projects", f"{path}/strings"


def test_search_through_the_index_finds_the_same(spark, searchable, register):
    for query in QUERIES:
        found = sg.search_landed(spark, *searchable, query)
        assert found.columns == register.columns
        assert rows(found.select("ref_id")) == rows(sg.search(register, query).select("ref_id")), query
    with pytest.raises(ValueError, match="pattern"):
        sg.search_landed(spark, *searchable, "(open")


def test_a_selective_search_reads_few_rows(spark, searchable):
    whole = sg.read_projects(spark, searchable[0])
    for query in ("ref/13989", r"ref/13989.*", "authority 11 ref/59922"):
        usual = rows_read(spark, lambda: sg.search(whole, query).collect())
        assert rows_read(spark, lambda: sg.search_landed(spark, *searchable, query).collect()) < usual / 2, query
    assert rows_read(spark, lambda: sg.search_landed(spark, *searchable, "no such text").collect()) < ROWS / 4


def test_index_of_awkward_texts(spark, tmp_path):
    data = [raw_row(i, site_name=n, operator="o" * 200_000 if i == 2 else None, technology="ÄÖ\n漢字", capacity_raw="1") for i, n in enumerate(["", None, "x", "İstanbul", "a\\b"])]
    df = sg.with_score(sg.clean(raw_frame(spark, data)))
    sg.write_projects(df.repartition(3), str(tmp_path / "p"))
    sg.write_search_index(spark, str(tmp_path / "p"), str(tmp_path / "i"))
    for query in ("öä", "äö\n漢", "ooooo", "i̇st", r"a\\b", "x ooo", "İst"):
        want = rows(sg.search(df, query).select("ref_id"))
        assert rows(sg.search_landed(spark, str(tmp_path / "p"), str(tmp_path / "i"), query).select("ref_id")) == want, query


def test_required_texts():
    assert required_texts("Plain text") == ["plain text"]
    assert required_texts("ab.cd") == ["ab", "cd"] and required_texts("ab+c") == ["ab", "c"] and required_texts("abc?d") == ["ab", "d"]
    assert required_texts("abc*") == ["ab"] and required_texts("abc{0,2}d") == ["ab", "d"] and required_texts("^ab$") == ["ab"]
    assert required_texts(r"a\.b\dc") == ["a.b", "c"] and required_texts("a(b|c)d[e-g]h") == ["a", "d", "h"]
    assert required_texts("x(?:y)z") == ["x", "z"] and required_texts("a([)]b)c") == ["a", "c"] and required_texts("(ab)?c") == ["c"]
    for none in ("a|b", "(?i)abc", r"\x41bc", r"\p{l}bc", r"\qab\e"):
        assert required_texts(none) == []


def test_five_thousand_names_in_one_plan(spark, register):
    rng = random.Random(2)
    every = [r.site_name for r in register.select("site_name").where("site_name is not null").distinct().collect()]
    names = rng.sample(sorted(every), 5000) + ["nobody", None, every[0], every[0]]
    table = spark.createDataFrame([(n, 1) for n in names], "site_name string, technology int")
    found = sg.comparables_among(register, table)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert rows(found) == rows(sg.comparables(register).where(F.col("site_name").isin([n for n in names if n])))


def test_bands_of_few_names_reach_the_scan(spark, plain, register):
    few = spark.createDataFrame([(CHOSEN_NAME,)], "site_name string")
    found = []
    read = rows_read(spark, lambda: found.extend(sg.comparables_among(plain, few).collect()))
    assert read < ROWS / 2 and sorted(found) == sorted(sg.comparables_of(register, CHOSEN_NAME).collect())


@pytest.mark.parametrize("seed", range(3))
def test_names_among_skewed_and_odd_capacities(spark, seed):
    rng = random.Random(seed)
    capacities = [0.0, 1e-9, 1.0, 1.3, 0.7, 1e300, float("inf"), -1.0, 100.0, 130.0, 91.0]
    data = [(i, rng.choice("abcdefgh") if i % 9 else None, rng.choice(["T", "U", None]), rng.choice(capacities), "r", "s", 1) for i in range(200)]
    df = spark.createDataFrame(data, PROJECT_SCHEMA).repartition(4)
    names = spark.createDataFrame([("a",), ("c",), ("h",), ("zz",)], "site_name string")
    want = sg.comparables(df).where("site_name in ('a', 'c', 'h')")
    for low, high in ((0.7, 1.3), (1.0, 1.0), (0.01, 50.0)):
        want = sg.comparables(df, low, high).where("site_name in ('a', 'c', 'h')")
        assert rows(sg.comparables_among(df, names, low, high)) == rows(want)
    assert sg.comparables_among(df, names.limit(0)).collect() == []
