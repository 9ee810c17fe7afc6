import math
from datetime import date, timedelta

import pytest

from countylens.operators import clean

DAY = date(2020, 11, 1)


@pytest.fixture(scope="module")
def signal(spark):
    rows = [(1001, DAY + timedelta(days=i), float(i)) for i in range(20)]
    rows += [(1000, DAY, 1.0), (2003, DAY, -1.0), (2003, DAY, math.nan), (2003, DAY, None),
             (2005, DAY + timedelta(days=3), 0.0)]
    return spark.createDataFrame(rows, "fips long, time_value date, value double").cache()


def codes(df):
    return sorted({r.fips for r in df.collect()})


def test_valid_values_drop_negative_nan_and_null(signal):
    assert clean.valid_values(signal).filter("fips = 2003").count() == 0
    assert clean.valid_values(signal).filter("fips = 2005").count() == 1


def test_county_rows(signal):
    assert codes(clean.county_rows(signal)) == [1001, 2003, 2005]


def test_in_state(signal, spark):
    assert codes(clean.in_state(signal, 2)) == [2003, 2005]
    assert clean.in_state(signal, None) is signal
    code = spark.createDataFrame([(1,)], "c long").scalar()
    assert codes(clean.in_state(signal, code)) == [1000, 1001]


def test_date_range_includes_both_ends(signal):
    got = clean.date_range(signal.filter("fips = 1001"), DAY + timedelta(days=2),
                           DAY + timedelta(days=4))
    assert sorted(r.value for r in got.collect()) == [2.0, 3.0, 4.0]


def test_reversed_range_is_refused(signal):
    with pytest.raises(ValueError, match="after"):
        clean.date_range(signal, DAY, DAY - timedelta(days=1))


def test_default_range_is_eight_days(signal):
    row = clean.default_range(signal).first()
    assert (row.min_date, row.max_date) == (DAY, DAY + timedelta(days=19))
    assert row.to_date - row.from_date == timedelta(days=7)
    assert clean.in_default_range(signal).count() == 8


def test_default_range_of_the_whole_signal(signal):
    part = clean.in_state(signal, 2)
    assert clean.in_default_range(part, span=signal).count() == 0
    assert clean.in_default_range(part).count() == 4


@pytest.mark.parametrize("empty,chosen", [("all", [1000, 1001, 2003, 2005]), ("none", [])])
def test_choosing_no_county(signal, spark, empty, chosen):
    assert codes(clean.select_counties(signal, [], empty)) == chosen
    table = spark.createDataFrame([], "fips long")
    assert codes(clean.select_counties(signal, table, empty)) == chosen


@pytest.mark.parametrize("empty", ["all", "none"])
def test_choosing_counties(signal, spark, empty):
    assert codes(clean.select_counties(signal, [2003, 9999], empty)) == [2003]
    table = spark.createDataFrame([(2003,), (2003,), (9999,)], "fips long")
    got = clean.select_counties(signal, table, empty)
    assert codes(got) == [2003] and got.count() == 3


def test_filters_reach_the_scan(spark, signal, plan, tmp_path):
    signal.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    text = plan(clean.date_range(clean.in_state(stored, 1), DAY, DAY).select("value"))
    assert "GreaterThanOrEqual(fips,1000)" in text and "LessThanOrEqual(fips,1999)" in text
    assert "GreaterThanOrEqual(time_value,2020-11-01)" in text


def test_unknown_meaning_of_empty(signal):
    with pytest.raises(ValueError):
        clean.select_counties(signal, [], "some")
