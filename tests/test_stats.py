import math
import random
import statistics
import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from countylens.functions import measures
from countylens.operators import stats

DAY = date(2020, 11, 1)


def signal(spark, rows):
    return spark.createDataFrame(
        rows, "signal string, fips long, time_value date, issue date, value double, "
              "state_name string, area_name string")


def points(spark, rows):
    return spark.createDataFrame(rows, "value double, measure_value double")


def test_latest_breaks_ties_and_keeps_unnamed(spark):
    later = date(2020, 11, 2)
    df = signal(spark, [
        ("s", 1001, DAY, later, 9.0, "x", "A"), ("s", 1001, later, DAY, 1.0, "x", "A"),
        ("s", 1001, later, later, 2.0, "x", "A"), ("s", 1001, later, later, 1.5, "x", "A"),
        ("s", 1003, DAY, DAY, 4.0, None, None)])
    want = {(1001, later, 2.0, "A"), (1003, DAY, 4.0, None)}
    for newest in (stats.latest(df), stats.latest_ranked(df)):
        assert newest.columns == df.columns
        assert {(r.fips, r.time_value, r.value, r.area_name) for r in newest.collect()} == want


def test_latest_per_signal(spark):
    df = signal(spark, [("a", 1, DAY, DAY, 1.0, None, None), ("b", 1, DAY, DAY, 2.0, None, None)])
    assert stats.latest(df, ("signal", "fips")).count() == 2


def _groups():
    rng = random.Random(5)
    draws = {
        1001: [float(i) for i in range(7)], 1003: [1.0, 2.0, 4.0, 9.0], 1005: [3.0],
        1007: [5.0, 8.0], 1009: [0.0] * 10 + [1e9], 1011: [7.25] * 40,
        1013: [rng.expovariate(0.001) for _ in range(30_001)],
        1015: [rng.random() for _ in range(30_000)],
        1017: [float(rng.randint(0, 3)) for _ in range(10_000)],
        1019: [0.0] * 5000 + [10.0] * 5000,
        1021: sorted(rng.gauss(50, 5) ** 2 for _ in range(20_000)),
    }
    for i in range(60):
        draws[2001 + i] = [rng.choice([rng.random(), float(rng.randint(0, 2))])
                           for _ in range(rng.randint(1, 40))]
    return draws


def test_range_stats_against_python(spark):
    draws = _groups()
    rows = [("s", f, DAY, DAY, v, "x", f"N{f}") for f, values in draws.items() for v in values]
    random.Random(1).shuffle(rows)
    got = {r.fips: r for r in stats.range_stats(signal(spark, rows).repartition(7)).collect()}
    assert got.keys() == draws.keys()
    for f, values in draws.items():
        row = got[f]
        assert (row.min, row.max) == (min(values), max(values))
        assert row.median == statistics.median(values), f
        assert math.isclose(row.average, statistics.fmean(values), rel_tol=1e-9)
        assert row.min <= row.median <= row.max


def test_range_stats_drop_unnamed_and_invalid(spark):
    df = signal(spark, [
        ("s", 1, DAY, DAY, 1.0, None, None), ("s", 3, DAY, DAY, -5.0, "x", "A"),
        ("s", 3, DAY, DAY, math.nan, "x", "A"), ("s", 3, DAY, DAY, 2.0, "x", "A"),
        ("s", 3, DAY, DAY, 3.0, "x", "other name")])
    rows = {(r.fips, r.area_name, r.median) for r in stats.range_stats(df).collect()}
    assert rows == {(3, "A", 2.0), (3, "other name", 3.0)}


def test_county_under_two_names(spark):
    """Each name has its own bracket, however far apart the values lie."""
    rows = [("s", 1001, DAY, DAY, float(v), "x", "A") for v in range(1, 101)]
    rows += [("s", 1001, DAY, DAY, float(v), "x", "B") for v in range(1000, 1101)]
    got = {r.area_name: r.median for r in stats.range_stats(signal(spark, rows)).collect()}
    assert got == {"A": 50.5, "B": 1050.0}


def test_statistics_agree_on_codes(spark):
    """Rows without a code have no group; a code of any length has one."""
    df = signal(spark, [("s", None, DAY, DAY, 1.0, "x", "A"), ("s", 123456, DAY, DAY, 2.0, "x", "B")])
    for name in stats.STATISTICS:
        assert [(r.fips, r.value) for r in stats.range_stat(df, name).collect()] == [(123456, 2.0)]


def test_latest_hashes_before_it_sorts(spark, plan):
    df = signal(spark, [("s", 1, DAY, DAY, 1.0, "x", "A")])
    text = plan(stats.latest(df))
    assert "max(time_value" in text and "HashAggregate" in text


@pytest.mark.parametrize("name,want", [("Max", 9.0), ("Min", 1.0), ("Average", 4.0), ("Median", 3.0)])
def test_range_stat_by_name(spark, name, want):
    df = signal(spark, [("s", 3, DAY, DAY, v, "x", "A") for v in (1.0, 2.0, 4.0, 9.0)])
    assert stats.range_stat(df, name).first().value == want
    with pytest.raises(ValueError):
        stats.range_stat(df, "Mode")


def test_median_sorts_no_county_whole(spark, plan, tmp_path):
    """No sketch and no object aggregation; the facts are read twice, whatever is made of them."""
    signal(spark, [("s", 3, DAY, DAY, v, "x", "A") for v in (1.0, 2.0)]).write.parquet(f"{tmp_path}/s")
    found = stats.range_stats(spark.read.parquet(f"{tmp_path}/s"))
    assert [r.median for r in found.collect()] == [1.5]
    text = plan(found).split("Initial Plan")[0]
    assert "isFinalPlan=true" in text
    assert "ObjectHashAggregate" not in text and "percentile" not in text and " median(" not in text
    assert text.count("FileScan parquet") <= 2


def test_median_of_extremes(spark):
    """Negative numbers do not count; zeros, tiny, huge and infinite ones do."""
    tiny = 5e-324
    sets = {1001: [0.0, tiny, 2 * tiny], 1003: [0.0, -0.0, 0.0, tiny], 1005: [1e308, math.inf, 1.0],
            1007: [math.inf, math.inf], 1009: [1 + k * 2.0 ** -52 for k in range(9)],
            1011: [2.2250738585072014e-308, 2.225073858507201e-308, 1e-310]}
    rows = [("s", f, DAY, DAY, v, "x", "A") for f, values in sets.items() for v in values]
    got = {r.fips: r.median for r in stats.range_stats(signal(spark, rows)).collect()}
    assert got == {f: statistics.median(values) for f, values in sets.items()}


def test_binary_places(spark):
    """In the order of the numbers, of every magnitude and on both sides of every power of two."""
    rng = random.Random(9)
    values = {0.0, -0.0, 1.0, math.inf, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308}
    values |= {struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(3000)}
    for k in range(-1074, 1024):
        values |= {2.0 ** k, math.nextafter(2.0 ** k, 0), math.nextafter(2.0 ** k, math.inf)}
    values = sorted(v for v in values if not math.isnan(v))
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    found = frame.select("v", *[measures.binary_place(F.col("v"), d).alias(f"d{d}") for d in (4, 20, 32)])
    rows = sorted(found.collect())
    for d in ("d4", "d20", "d32"):
        places = [r[d] for r in rows]
        assert places == sorted(places)
    places = {r.v: r.d20 for r in rows}
    assert places[1.0] == 1 << 20 and places[0.0] < places[5e-324] and places[math.inf] > places[1.7976931348623157e308]
    assert spark.range(1).select(measures.binary_place(F.lit(1.75), 4)).first()[0] == 16 + 12


def test_date_ranges(spark):
    df = signal(spark, [("a", 1, DAY, DAY, 1.0, None, None),
                        ("a", 1, date(2020, 12, 1), DAY, 1.0, None, None)])
    assert stats.date_ranges(df).first() == ("a", DAY, date(2020, 12, 1))


def test_correlation_signs_and_bounds(spark):
    up = stats.correlation(points(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)])).first()
    assert math.isclose(up.correlation, 1.0) and up.points == 3
    rng = random.Random(2)
    r = stats.correlation(points(spark, [(rng.random(), rng.random()) for _ in range(500)])).first()
    assert abs(r.correlation) <= 1


@pytest.mark.parametrize("rows", [[(1.0, 5.0), (2.0, 5.0)], [(1.0, 1.0)], []])
def test_correlation_without_spread_is_null(spark, rows):
    assert stats.correlation(points(spark, rows)).first().correlation is None


def test_correlation_skips_pairs_with_null(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (100.0, None), (None, -100.0)]
    full = stats.correlation(points(spark, rows)).first().correlation
    assert math.isclose(full, stats.correlation(points(spark, rows[:3])).first().correlation)


def test_regression_line(spark):
    df = points(spark, [(0.0, 1.0), (1.0, 3.0), (2.0, 5.0), (50.0, None)])
    row = stats.regression(df).first()
    assert (row.slope, row.intercept, row.points) == (2.0, 1.0, 3) and math.isclose(row.r2, 1)
    line = stats.regression_line(df).first()
    assert (line.x_start, line.y_start, line.x_end, line.y_end) == (0.0, 1.0, 2.0, 5.0)
    assert stats.regression(points(spark, [(1.0, 1.0), (1.0, 2.0)])).first().slope is None


def test_extents(spark):
    row = stats.extents(points(spark, [(-3.0, 11.0), (29.5, 40.0)])).first()
    assert row == (-10, 30, 10, 40)


def test_matrix_and_states(spark):
    newest = spark.createDataFrame(
        [("s", f, float(v)) for f, v in ((1001, 1), (1003, 2), (1005, 4), (2001, 1), (2003, 9))],
        "signal string, fips long, value double")
    long = spark.createDataFrame(
        [(f, m, float(v)) for f, v in ((1001, 3), (1003, 2), (1005, 1), (2001, 1), (2003, 2))
         for m in ("m", "n")] + [(1001, "flat", 1.0), (1003, "flat", 1.0)],
        "fips long, measure string, measure_value double")
    matrix = {(r.signal, r.measure): r for r in stats.correlation_matrix(newest, long).collect()}
    assert matrix["s", "flat"].correlation is None and matrix["s", "m"].points == 5
    states = {(r.measure, r.state_fips): r.correlation
              for r in stats.correlation_by_state(newest, long).collect()}
    assert states["m", 1] < 0 and math.isclose(states["m", 2], 1.0)
