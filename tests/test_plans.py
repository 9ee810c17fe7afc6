from datetime import date, timedelta

import pytest

from countylens import catalog
from countylens.plans import etl, reports

from test_sources import write

CASES, DAILY = "Cumulative Cases per 100K people", "Daily New Cases per 100K people"
POVERTY = "% Total Population in Poverty (2018)"
LAST = date(2020, 11, 29)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """All clean tables, made from raw files."""
    root = tmp_path_factory.mktemp("etl")
    raw, out = root / "raw", root / "out"
    write(raw / "fips/state_fips_2019.csv",
          "a,,\nb,,\nc,,\nd,,\ne,,\nRegion,State (FIPS),Name\n1,0,South Region\n1,12,Florida\n"
          "1,42,Pennsylvania\n")
    write(raw / "fips/area_fips_2019.csv",
          "a\nb\nc\nd\nSummary Level,State Code (FIPS),County Code (FIPS),"
          "Area Name (including legal/statistical area description)\n"
          "40,12,0,FLORIDA\n50,12,1,alachua county\n50,12,3,st. john's-x\n50,42,3,allegheny\n"
          "50,42,5,unseen\n50,99,1,nowhere\n")
    days = [LAST - timedelta(days=i) for i in range(10)]
    lines = [f"{i},{f},{d},{d},{f % 10 + n}" for i, (n, d, f) in enumerate(
        (n, d, f) for n, d in enumerate(days) for f in (12000, 12001, 12003, 42003, 77001))]
    for s in catalog.SIGNALS:
        write(raw / f"signals/{s.file}.csv",
              ",geo_value,time_value,issue,value\n" + "\n".join(lines) + f"\n999,12001,{LAST},{LAST},-9\n")
    for spec in catalog.INDICATORS:
        head = "".join("note\n" for _ in range(spec.preamble))
        names = [*spec.keys, *spec.measures]
        quoted = ",".join(f'"{n}"' for n in names)
        body = "".join(f"{f},XX,area {f}," + ",".join(str(f % 1000 * 2) for _ in spec.measures) + "\n"
                       for f in (12000, 12001, 12003, 42003, 42005))
        write(raw / f"indicators/{spec.sheet}.csv", head + quoted + "\n" + body)
    etl.build_all(spark, str(raw), str(out))
    return str(out)


@pytest.fixture(scope="module")
def tables(spark, built):
    signals = etl.load_signal(spark, built, CASES).unionByName(etl.load_signal(spark, built, DAILY))
    words = spark.createDataFrame([("FL", "Stay home stay home work"), ("PA", "steel steel")],
                                  "state string, text string")
    return reports.Tables(
        spark.read.parquet(f"{built}/state_dim"), spark.read.parquet(f"{built}/county_dim"), signals,
        {s.category: etl.load_indicator(spark, built, s.category) for s in catalog.INDICATORS}, words)


def test_county_dim(tables):
    rows = {r.fips: (r.state_name, r.area_name) for r in tables.county_dim.collect()}
    assert rows == {12001: ("Florida", "Alachua County"), 12003: ("Florida", "St. John'S-X"),
                    42003: ("Pennsylvania", "Allegheny"), 42005: ("Pennsylvania", "Unseen"),
                    99001: (None, "Nowhere")}


def test_signal(tables):
    rows = tables.signal(CASES).collect()
    assert len(rows) == 40  # no state total, no negative value
    assert {r.area_name for r in rows if r.fips == 77001} == {None}


def test_stored_signal_is_pruned(spark, built, plan):
    text = plan(etl.load_signal(spark, built, CASES).filter("fips between 12000 and 12999"))
    assert "PartitionFilters: [isnotnull(signal" in text
    assert "GreaterThanOrEqual(fips,12000)" in text and "GreaterThanOrEqual(value,0.0)" in text


def test_indicator_map(tables):
    table = reports.indicator_map(tables.county_dim, tables.indicators["Poverty"], POVERTY)
    assert {r.fips: r.value for r in table.collect()} == {
        12001: 2.0, 12003: 6.0, 42003: 6.0, 42005: 10.0, 99001: None}
    florida = reports.indicator_map(tables.county_dim, tables.indicators["Poverty"], POVERTY,
                                    reports.state_named(tables.state_dim, "Florida"))
    assert sorted(r.fips for r in florida.collect()) == [12001, 12003]
    with pytest.raises(ValueError):
        reports.indicator_map(tables.county_dim, tables.indicators["Poverty"], "no such")


@pytest.mark.parametrize("statistic,want", [("Max", 8.0), ("Min", 1.0), ("Average", 4.5),
                                            ("Median", 4.5)])
def test_signal_map_of_the_last_eight_days(tables, statistic, want):
    table = reports.signal_map(tables.county_dim, tables.signal(DAILY), statistic, 12)
    rows = {r.fips: r for r in table.collect()}
    assert set(rows) == {12001, 12003}
    assert table.columns == ["fips", "area_name", "value", "has_data"]
    assert rows[12001].value == want and rows[12001].has_data


def test_signal_map_range(tables):
    table = reports.signal_map(tables.county_dim, tables.signal(DAILY), "Max", None, LAST, LAST)
    rows = {r.fips: (r.value, r.has_data) for r in table.collect()}
    assert rows[12001] == (1.0, True) and rows[42005] == (None, False)
    with pytest.raises(ValueError):
        reports.signal_map(tables.county_dim, tables.signal(DAILY), "Max", None, LAST,
                           LAST - timedelta(days=1))


def test_cumulative_map(tables):
    rows = {r.fips: r for r in reports.cumulative_map(tables.county_dim, tables.signal(CASES)).collect()}
    assert rows[12001].value == 1.0 and rows[12001].time_value == LAST
    assert rows[99001].value is None and len(rows) == 5


def test_scatter_selection_leaves_the_figure_alone(tables):
    full = reports.scatter(tables.signal(CASES), tables.indicators["Poverty"], POVERTY)
    some = reports.scatter(tables.signal(CASES), tables.indicators["Poverty"], POVERTY,
                           counties=[12001])
    assert {r.fips for r in full.points.collect()} == {12001, 12003, 42003}
    assert [r.fips for r in some.points.collect()] == [12001]
    assert full.correlation.first() == some.correlation.first()
    assert full.line.first() == some.line.first()
    refit = reports.scatter(tables.signal(CASES), tables.indicators["Poverty"], POVERTY,
                            counties=[12001], refit=True)
    assert refit.line.first().slope is None
    assert full.extents.first() == (0, 10, 0, 10)
    assert reports.correlation_title(full, CASES, POVERTY).first().title.endswith(": 1.0000")


def test_scatter_joins_without_shuffling_facts_by_name(tables, plan):
    text = plan(reports.scatter(tables.signal(CASES), tables.indicators["Poverty"], POVERTY).points)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Python" not in text and "CartesianProduct" not in text


def test_time_series(tables):
    none = reports.time_series(tables.signal(DAILY), 12, counties=[])
    assert none.count() == 0
    rows = reports.time_series(tables.signal(DAILY), 12, LAST - timedelta(days=1), LAST,
                               [12003, 12001]).collect()
    assert [(r.fips, r.time_value) for r in rows] == [
        (f, LAST - timedelta(days=d)) for f in (12001, 12003) for d in (1, 0)]
    assert reports.time_series(tables.signal(DAILY), 12, counties=[], empty="all").count() == 16


def test_as_of(tables):
    assert reports.as_of(tables.signal(CASES)).first().as_of == "November 29, 2020"


@pytest.mark.parametrize("name", [n for n, p in catalog.PRESETS.items() if p.measure])
def test_presets(tables, name):
    view = reports.preset(tables, name)
    assert sorted(r.fips for r in view.points.collect()) == [12001, 12003]


def test_other_presets(tables):
    words = reports.preset(tables, "Narrative Tweets").collect()
    assert [(r.word, r["count"]) for r in words] == [("home", 2), ("stay", 2), ("work", 1)]
    assert [r.fips for r in reports.preset(tables, "Manual").points.collect()] == [42003]
