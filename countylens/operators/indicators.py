"""Indicator tables, wide and long."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countylens import catalog
from countylens.functions import areas


def measure_of(indicator: DataFrame, measure: str, name: str = "measure_value") -> DataFrame:
    """One measure of a wide table, NaN as null."""
    if measure not in catalog.measures(indicator):
        raise ValueError(f"{measure!r} is not one of {catalog.measures(indicator)}")
    return indicator.select(
        "fips", areas.number_or_null(F.col(f"`{measure}`").cast("double")).alias(name))


def to_long(indicator: DataFrame, category: str) -> DataFrame:
    """One row per county and measure."""
    names = catalog.measures(indicator)
    numbers = indicator.select(
        "fips", *[areas.number_or_null(F.col(f"`{c}`").cast("double")).alias(c) for c in names])
    return (numbers.unpivot("fips", [f"`{c}`" for c in names], "measure", "measure_value")
            .select(F.lit(category).alias("category"), "fips", "measure", "measure_value"))
