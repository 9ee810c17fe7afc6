"""From raw sheets and fetched signals to clean tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from countylens import catalog, schemas
from countylens.functions import areas
from countylens.operators import clean
from countylens.operators.lookup import area_join
from countylens.sources import readers, writers

COUNTY_LEVEL = 50
MAX_STATE = 99


def project(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Chosen columns under new names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def build_county_dim(sheet: DataFrame, state_dim: DataFrame) -> DataFrame:
    """Counties of an area sheet with code, title-case name and state name, where known."""
    counties = sheet.filter(F.col("summary_level") == COUNTY_LEVEL).select(
        "state_fips", "county_fips",
        areas.fips(F.col("state_fips"), F.col("county_fips")).alias("fips"),
        areas.title_case(F.col("area_name")).alias("area_name"))
    states = state_dim.select("state_fips", F.col("name").alias("state_name"))
    return (area_join(counties, states, "left", "state_fips", MAX_STATE)
            .select(schemas.COUNTY_DIM.names))


def build_signal(raw: DataFrame, county_dim: DataFrame, name: str | None = None) -> DataFrame:
    """County rows of a fetched signal with state and area names, null for unknown counties."""
    rows = clean.county_rows(raw, "geo_value").withColumnRenamed("geo_value", "fips")
    if name is not None:
        rows = rows.withColumn("signal", F.lit(name))
    names = county_dim.select("fips", "state_name", "area_name")
    return area_join(rows, names, "left").select(schemas.SIGNAL.names)


def build_all(spark: SparkSession, raw: str, out: str) -> None:
    """All clean tables from a folder of raw files, as Parquet.

    Signals are stored in a folder per signal, their files cut by county and day, so that reading one
    signal or one state touches only its files.
    """
    state_dim = readers.read_state_sheet(spark, f"{raw}/fips/state_fips_2019.csv")
    county_sheet = readers.read_county_sheet(spark, f"{raw}/fips/area_fips_2019.csv")
    writers.write_table(state_dim, f"{out}/state_dim")
    writers.write_table(build_county_dim(county_sheet, state_dim), f"{out}/county_dim",
                        sort_by=("fips",))
    county_dim = spark.read.schema(schemas.COUNTY_DIM).parquet(f"{out}/county_dim")

    signals = readers._union(
        build_signal(df, county_dim, name)
        for name, df in readers.read_signals_raw(spark, f"{raw}/signals").items())
    writers.write_table(signals, f"{out}/signal", partition_by=("signal",),
                        sort_by=("fips", "time_value"))

    for spec in catalog.INDICATORS:
        sheet = readers.read_indicator_sheet(spark, f"{raw}/indicators/{spec.sheet}.csv",
                                             spec.category)
        # names with blanks and brackets are kept out of file schemas
        short = {m: f"m{i}" for i, m in enumerate(spec.measures.values())}
        writers.write_table(sheet.withColumnsRenamed(short), f"{out}/{spec.file}",
                            sort_by=("fips",))


def load_indicator(spark: SparkSession, out: str, category: str) -> DataFrame:
    spec = catalog.indicator(category)
    long_names = {f"m{i}": m for i, m in enumerate(spec.measures.values())}
    return spark.read.parquet(f"{out}/{spec.file}").withColumnsRenamed(long_names)


def load_signal(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One stored signal, valid values only."""
    stored = spark.read.schema(schemas.SIGNAL).parquet(f"{out}/signal")
    return clean.valid_values(stored.filter(F.col("signal") == name)).select(schemas.SIGNAL.names)
