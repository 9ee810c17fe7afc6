"""Declared schemas of stored tables. Nothing is inferred from data."""

from pyspark.sql.types import (
    DateType, DoubleType, LongType, StringType, StructField, StructType,
)

STATE_DIM = StructType([
    StructField("state_fips", LongType()),
    StructField("name", StringType()),
])

COUNTY_DIM = StructType([
    StructField("state_fips", LongType()),
    StructField("county_fips", LongType()),
    StructField("fips", LongType()),
    StructField("state_name", StringType()),
    StructField("area_name", StringType()),
])

SIGNAL_RAW = StructType([
    StructField("geo_value", LongType()),
    StructField("time_value", DateType()),
    StructField("issue", DateType()),
    StructField("value", DoubleType()),
])

SIGNAL = StructType([
    StructField("signal", StringType()),
    StructField("fips", LongType()),
    StructField("time_value", DateType()),
    StructField("issue", DateType()),
    StructField("value", DoubleType()),
    StructField("state_name", StringType()),
    StructField("area_name", StringType()),
])

INDICATOR_LONG = StructType([
    StructField("category", StringType()),
    StructField("fips", LongType()),
    StructField("measure", StringType()),
    StructField("measure_value", DoubleType()),
])

PLACE = StructType([
    StructField("country_code", StringType()),
    StructField("place_type", StringType()),
    StructField("full_name", StringType()),
])

TWEET = StructType([
    StructField("id", LongType()),
    StructField("lang", StringType()),
    StructField("place", PLACE),
    StructField("retweeted_status", StructType([StructField("full_text", StringType())])),
    StructField("full_text", StringType()),
    StructField("text", StringType()),
])

# Headers of the stored CSV files, by the column each becomes.
STATE_DIM_HEADER = {"State FIPS": "state_fips", "Name": "name"}
COUNTY_DIM_HEADER = {"State FIPS": "state_fips", "County FIPS": "county_fips", "FIPS": "fips",
                     "State Name": "state_name", "Area Name": "area_name"}
SIGNAL_HEADER = {"FIPS": "fips", "time_value": "time_value", "issue": "issue", "value": "value",
                 "State Name": "state_name", "Area Name": "area_name"}
INDICATOR_HEADER = {"FIPS": "fips", "State Abrv": "state_abrv", "Area Name": "area_name"}
