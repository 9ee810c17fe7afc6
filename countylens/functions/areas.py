"""Expressions on area codes, names, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COUNTIES_PER_STATE = 1000
MAX_FIPS = 99_999


def fips(state: Column, county: Column) -> Column:
    """Two-digit state and three-digit county code as one number."""
    return state.cast("bigint") * COUNTIES_PER_STATE + county.cast("bigint")


def state_of(code: Column) -> Column:
    return F.call_function("div", code, F.lit(COUNTIES_PER_STATE))


def is_county(code: Column) -> Column:
    """State totals carry county number 0."""
    return code % COUNTIES_PER_STATE != 0


def is_in_state(code: Column, state_fips: int | Column) -> Column:
    """A range on the stored column, so that scans can skip row groups by it."""
    first = state_fips * COUNTIES_PER_STATE
    return code.between(first, first + COUNTIES_PER_STATE - 1)


def checked_code(code: Column, highest: int = MAX_FIPS) -> Column:
    """The code itself; the job fails where it lies outside the code space."""
    return F.when(code.between(0, highest), code).otherwise(
        F.raise_error(F.format_string("%s is not an area code up to " + str(highest), code)))


def title_case(name: Column) -> Column:
    """Capital after every non-letter, so ``o'neil`` becomes ``O'Neil`` and ``2nd`` ``2Nd``."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                             F.substring(r, F.lit(2), F.length(r)))), "")


def round_to(number: Column, nearest: int, up: bool = True) -> Column:
    steps = number / F.lit(nearest)
    return ((F.ceil(steps) if up else F.floor(steps)) * nearest).cast("bigint")


def parse_date(text: Column) -> Column:
    """ISO date, null where the text is none."""
    return F.trim(text).try_cast("date")


def parse_long(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")


def number_or_null(number: Column) -> Column:
    """NaN as null, so that statistics leave the pair out."""
    return F.when(~F.isnan(number), number)


def is_valid_value(value: Column) -> Column:
    """Neither negative nor missing. NaN >= 0 holds in Spark, hence the second test."""
    return (value >= 0) & ~F.isnan(value)


def as_of_label(day: Column) -> Column:
    """Such as ``November 29, 2020``."""
    return F.date_format(day, "MMMM dd, yyyy")
