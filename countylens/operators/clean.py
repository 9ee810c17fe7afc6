"""Row filters on signals and indicator tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from countylens import catalog
from countylens.functions import areas
from countylens.operators.lookup import area_join


def valid_values(signal: DataFrame, value: str = "value") -> DataFrame:
    return signal.filter(areas.is_valid_value(F.col(value)))


def county_rows(df: DataFrame, code: str = "fips") -> DataFrame:
    return df.filter(areas.is_county(F.col(code)))


def in_state(df: DataFrame, state_fips: int | Column | None, code: str = "fips") -> DataFrame:
    """Rows of one state, or all rows where no state is given."""
    return df if state_fips is None else df.filter(areas.is_in_state(F.col(code), state_fips))


def check_range(first: date, last: date) -> None:
    if first > last:
        raise ValueError(f"first day {first} lies after last day {last}")


def date_range(df: DataFrame, first: date, last: date, day: str = "time_value") -> DataFrame:
    """Rows from the first to the last day, both included."""
    check_range(first, last)
    return df.filter(F.col(day).between(F.lit(first), F.lit(last)))


def default_range(signal: DataFrame, days: int = catalog.DEFAULT_DAYS) -> DataFrame:
    """One row: the span of the data and the range shown when none is chosen."""
    return signal.agg(
        F.min("time_value").alias("min_date"), F.max("time_value").alias("max_date"),
    ).select("min_date", "max_date",
             F.date_sub("max_date", days).alias("from_date"), F.col("max_date").alias("to_date"))


def in_default_range(signal: DataFrame, days: int = catalog.DEFAULT_DAYS,
                     span: DataFrame | None = None) -> DataFrame:
    """Rows of the last days of one signal.

    The bound is a scalar subquery: computed once from the day column alone, then an ordinary
    filter value. ``span`` is the unfiltered signal where only a part (say a state) is asked for.
    """
    bounds = default_range(signal if span is None else span, days)
    return signal.filter((F.col("time_value") >= bounds.select("from_date").scalar())
                         & (F.col("time_value") <= bounds.select("to_date").scalar()))


def select_counties(df: DataFrame, codes: Iterable[int] | DataFrame, empty: str = "all",
                    code: str = "fips") -> DataFrame:
    """Rows of chosen counties; ``empty`` says what choosing none means, ``all`` or ``none``.

    A long choice is given as a DataFrame with the code column.
    """
    if empty not in ("all", "none"):
        raise ValueError(f"empty must be 'all' or 'none', not {empty!r}")
    if isinstance(codes, DataFrame):
        marked = area_join(df, codes.select(code).withColumn("_chosen", F.lit(True)), "left", code)
        chosen = F.col("_chosen").isNotNull()
        if empty == "all":
            chosen |= codes.agg(F.count(code).alias("n")).scalar() == 0
        return marked.filter(chosen).select(df.columns)
    codes = list(codes)
    if not codes:
        return df if empty == "all" else df.filter(F.lit(False))
    return df.filter(F.col(code).isin(*codes))
