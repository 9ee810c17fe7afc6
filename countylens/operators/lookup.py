"""Joins against area tables.

An area table is keyed by a code of at most five digits, so one row per code bounds it at
100,000 rows however large the data grows. ``one_row_per_code`` enforces both halves of that bound
and ``area_join`` broadcasts nothing that has not passed it. Every other join of the package is
left to Spark, which compares its own size estimate with the broadcast threshold and otherwise
shuffles, splitting hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countylens.functions import areas


def one_row_per_code(df: DataFrame, code: str = "fips", highest: int = areas.MAX_FIPS) -> DataFrame:
    """At most one row per area code, the greatest by the other columns where there are several."""
    others = [c for c in df.columns if c != code]
    checked = df.filter(F.col(code).isNotNull()).withColumn(
        code, areas.checked_code(F.col(code), highest))
    if not others:
        return checked.distinct()
    kept = checked.groupBy(code).agg(F.max(F.struct(*[_quoted(c) for c in others])).alias("_kept"))
    return kept.select(code, *[F.col("_kept").getField(c).alias(c) for c in others])


def area_join(facts: DataFrame, areas_table: DataFrame, how: str = "inner", code: str = "fips",
              highest: int = areas.MAX_FIPS) -> DataFrame:
    """Facts with the columns of an area table; facts are not shuffled."""
    return facts.join(F.broadcast(one_row_per_code(areas_table, code, highest)), code, how)


def map_lookup(area_ids: DataFrame, features: DataFrame, value: str) -> DataFrame:
    """Every area exactly once, with its feature if there is one."""
    joined = area_join(area_ids, features, "left")
    return joined.withColumn("has_data", F.col(f"`{value}`").isNotNull())


def _quoted(name: str):
    return F.col(f"`{name}`")
