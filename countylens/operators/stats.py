"""Statistics of signals and of signal-indicator pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from countylens.functions import areas, measures
from countylens.operators import clean

STATISTICS = {"Max": "max", "Min": "min", "Average": "average", "Median": "median"}

# Binary digits behind a value's first one by which values are counted to find a median.
HEAD, MIDDLE = 4, 20
COUNTY = ("fips", "area_name")
# What goes along with the part of a county's values that holds its middle ranks.
CARRIED = ("before", "lower", "upper", "min", "max", "average")


def latest(signal: DataFrame, keys: Sequence[str] = ("fips",)) -> DataFrame:
    """The newest row per key; later issue, then greater value, where days tie.

    First the newest day per key, a hash aggregation of two short columns; only the rows of that day
    are then compared whole.
    """
    order = [c for c in ("issue", "value") if c in signal.columns]
    rest = [c for c in signal.columns if c not in keys and c not in order and c != "time_value"]
    days = signal.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.max("time_value").alias("_day"))
    same = F.col("time_value").eqNullSafe(F.col("_day"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    newest = (signal.join(days, same).select(*signal.columns).groupBy(*keys, "time_value")
              .agg(F.max(F.struct(*order, *rest)).alias("_row")))
    return newest.select(*keys, "time_value", "_row.*").select(*signal.columns)


def latest_ranked(signal: DataFrame, keys: Sequence[str] = ("fips",)) -> DataFrame:
    """``latest`` by row number, for callers that order differently or want the newest few.

    The limit on the row number is applied before the shuffle, so a hot key sends one row per task.
    """
    order = [c for c in ("time_value", "issue", "value") if c in signal.columns]
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (signal.withColumn("_n", F.row_number().over(newest_first))
            .filter(F.col("_n") == 1).drop("_n"))


def date_ranges(signal: DataFrame) -> DataFrame:
    return signal.groupBy("signal").agg(F.min("time_value").alias("min_date"),
                                        F.max("time_value").alias("max_date"))


def _counties(signal: DataFrame) -> DataFrame:
    """The rows that statistics per county are about: a code, a name and a valid value."""
    return (clean.valid_values(signal)
            .filter(F.col("fips").isNotNull() & F.col("area_name").isNotNull())
            .select(*COUNTY, "value"))


def range_stats(signal: DataFrame) -> DataFrame:
    """Min, max, average and exact median of the values per county.

    Rows without a code or an area name have no group; a code under two names has two. A median
    needs order, and one county may hold a third of all rows, so no county is sorted whole: values
    are counted by exponent and the next four binary digits, at most some 35,000 counts a county. The
    counts tell which heads hold the middle ranks; only values with these heads are read again, each
    value once and counted, and of them only those that share 16 more digits are put in order. The
    facts are read twice, and all is exact at any size.
    """
    rows = _counties(signal).withColumn("head", measures.binary_place(F.col("value"), HEAD))
    heads = rows.groupBy(*COUNTY, "head").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"),
        F.max("value").alias("most"))
    county = Window.partitionBy(*COUNTY)
    total = F.sum("n").over(county)
    heads = heads.select(
        *COUNTY, "head", "n", F.lit(0).cast("bigint").alias("before"), F.floor((total + 1) / 2).alias("lower"),
        F.floor((total + 2) / 2).alias("upper"), F.min("least").over(county).alias("min"),
        F.max("most").over(county).alias("max"), (F.sum("total").over(county) / total).alias("average"))
    values = _within(rows, _holding(heads, COUNTY, "head"), [*COUNTY, "head"]).groupBy(
        *COUNTY, "head", *CARRIED, "value").agg(F.count("*").alias("n"))
    values = values.withColumn("middle", measures.binary_place(F.col("value"), MIDDLE))
    # What is read of the values is the same in both uses, so that they are made once.
    middles = values.groupBy(*COUNTY, "head", *CARRIED, "middle").agg(
        F.sum("n").alias("n"), F.max("value").alias("most"))
    chosen = _holding(middles.filter(F.col("most") >= 0), [*COUNTY, "head"], "middle")
    last = _within(values.select(*COUNTY, "head", "middle", "value", "n"), chosen, [*COUNTY, "head", "middle"])
    ends = _holding(last, [*COUNTY, "head", "middle"], "value")
    # What is left covers both ranks, so its ends are the values at them.
    low, high = F.min("value"), F.max("value")
    return ends.groupBy(*COUNTY, "min", "max", "average").agg(
        F.when(low == high, low).otherwise((low + high) / 2).alias("median"))


def _within(rows: DataFrame, slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows in chosen slots, with what the slots carry."""
    named = slots.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_{k}" for k in keys])


def _holding(counts: DataFrame, group: Sequence[str], slot: str) -> DataFrame:
    """The slots of each group, in order, that hold the rank ``lower`` or ``upper``.

    ``before`` comes in as the number of values in front of the group, and goes out as the number of
    those in front of the slot.
    """
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*group).orderBy(slot))
    found = counts.withColumn("_upto", upto)
    holds = (F.col("_upto") >= F.col("lower")) & (F.col("_upto") - F.col("n") < F.col("upper"))
    return found.filter(holds).withColumn("before", F.col("_upto") - F.col("n")).select(*group, slot, *CARRIED)


def range_stat(signal: DataFrame, statistic: str = "Max") -> DataFrame:
    """One statistic per county, chosen by its display name.

    All but the median come from a single aggregation.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"statistic must be one of {list(STATISTICS)}, not {statistic!r}")
    name = STATISTICS[statistic]
    if name == "median":
        return range_stats(signal).select("fips", "area_name", F.col("median").alias("value"))
    function = {"max": F.max, "min": F.min, "average": F.avg}[name]
    return _counties(signal).groupBy(*COUNTY).agg(function("value").alias("value"))


def correlation(points: DataFrame, x: str = "value", y: str = "measure_value",
                by: Sequence[str | Column] = ()) -> DataFrame:
    return points.groupBy(*by).agg(
        measures.pearson(F.col(x), F.col(y)).alias("correlation"),
        F.regr_count(y, x).alias("points"))


def regression(points: DataFrame, x: str = "value", y: str = "measure_value",
               by: Sequence[str | Column] = ()) -> DataFrame:
    """Least-squares line of y on x."""
    return points.groupBy(*by).agg(*_line(x, y))


def regression_line(points: DataFrame, x: str = "value", y: str = "measure_value",
                    by: Sequence[str] = ()) -> DataFrame:
    """The line's end points, at the least and the greatest x that has a y."""
    seen = F.when(F.col(y).isNotNull(), F.col(x))
    fitted = points.groupBy(*by).agg(*_line(x, y), F.min(seen).alias("x_start"),
                                     F.max(seen).alias("x_end"))

    def height(at: str) -> Column:
        return F.col("slope") * F.col(at) + F.col("intercept")

    return fitted.select(*by, "slope", "intercept", "x_start", height("x_start").alias("y_start"),
                         "x_end", height("x_end").alias("y_end"))


def _line(x: str, y: str) -> list[Column]:
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("points")]


def extents(points: DataFrame, x: str = "value", y: str | None = "measure_value",
            nearest: int = 10) -> DataFrame:
    """Axis ends, rounded outward."""
    ends = [(F.min(x), False, "x_min"), (F.max(x), True, "x_max")]
    if y is not None:
        ends += [(F.min(y), False, "y_min"), (F.max(y), True, "y_max")]
    return points.agg(*[areas.round_to(end, nearest, up).alias(name) for end, up, name in ends])


def series_extents(series: DataFrame, nearest: int = 10) -> DataFrame:
    """First and last day, and the value axis ends, of a time series."""
    return series.agg(
        F.min("time_value").alias("x_min"), F.max("time_value").alias("x_max"),
        areas.round_to(F.min("value"), nearest, up=False).alias("y_min"),
        areas.round_to(F.max("value"), nearest).alias("y_max"))


def indicator_pairs(latest_signals: DataFrame, indicator_long: DataFrame) -> DataFrame:
    """Every latest signal row with every measure of its county.

    Both sides hold one row per county and name, so the join's keys are spread evenly.
    """
    return latest_signals.select("signal", "fips", "value").join(
        indicator_long.select("fips", "measure", "measure_value"), "fips")


def correlation_matrix(latest_signals: DataFrame, indicator_long: DataFrame) -> DataFrame:
    """Each signal against each measure over all counties, in one aggregation."""
    return correlation(indicator_pairs(latest_signals, indicator_long), by=("signal", "measure"))


def correlation_by_state(latest_signals: DataFrame, indicator_long: DataFrame) -> DataFrame:
    """Each signal against each measure over the counties of each state."""
    state = areas.state_of(F.col("fips")).alias("state_fips")
    return correlation(indicator_pairs(latest_signals, indicator_long),
                       by=("signal", "measure", state))
