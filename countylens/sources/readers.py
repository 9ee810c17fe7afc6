"""Readers of stored tables, sheets, texts and tweet objects.

CSV columns are known by name. Files of one path may differ in which columns they have and in what order:
the header of every file is looked at, files with equal headers form a layout, and each layout is one
scan that finds its columns by position. A file that lacks a column is an error that names it; a file of
no bytes holds no rows.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from countylens import catalog, schemas, storage
from countylens.functions import areas, tweets as tweet_fn
from countylens.operators import clean, indicators, stats


# Headers that are read at a time.
OPEN = 16


def read_indexed_csv(spark: SparkSession, path: str | list[str], header: Mapping[str, str],
                     schema: StructType) -> DataFrame:
    """Columns of a CSV by the names in its header, in any order; others are dropped.

    Everything is read as text and converted with ``try_cast``, so a dirty cell is null. Several files,
    or a folder of them, may differ in their columns; one that lacks a wanted column is an error.
    """
    types = {f.name: f.dataType for f in schema}
    raw = _named_csv(spark, path, header)
    return raw.select(*[
        F.trim(F.col(f"`{c}`")).try_cast(types.get(c, StringType())).alias(c)
        if not isinstance(types.get(c, StringType()), StringType) else F.col(f"`{c}`")
        for c in header.values()])


def _named_csv(spark: SparkSession, path: str | list[str], columns: Mapping[str, str],
               above: int | None = None) -> DataFrame:
    """Columns found by name and renamed, as text. With ``above``, the header comes after so many lines,
    and they and it are left among the rows."""
    parts = []
    for names, files in layouts(spark, path, columns, above or 0).items():
        by_position = StructType([StructField(f"_c{i}", StringType()) for i in range(len(names))])
        # names are matched here, so the reader is not to compare them with the positions
        raw = spark.read.schema(by_position).csv(files, header=above is None, enforceSchema=True)
        parts.append(raw.select(*[F.col(f"_c{names.index(old)}").alias(new) for old, new in columns.items()]))
    return _union(parts)


def layouts(spark: SparkSession, path: str | list[str], columns: Iterable[str], above: int = 0
            ) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their column names, in the line after ``above`` others.

    Of each file the first lines are read, some files at a time; there are few layouts, however many
    files. A name that comes twice in a header is found at its first place.
    """
    found = defaultdict(list)
    files = storage.data_files(spark.read.text(path))
    with ThreadPoolExecutor(OPEN) as pool:
        heads = pool.map(lambda f: storage.first_lines(spark, re.sub(r"\\(.)", r"\1", f), above + 1), files)
        for file, lines in zip(files, heads):
            if lines is None:
                continue
            names = tuple(next(csv.reader(lines[above:]), ()))
            missing = [c for c in columns if c not in names]
            if missing:
                raise ValueError(f"{file} has no columns {missing} in line {above + 1}")
            found[names].append(file)
    if not found:
        raise ValueError(f"{path} holds no file with a header")
    return dict(found)


def read_state_dim(spark: SparkSession, path: str) -> DataFrame:
    """States without the region and division rows, which carry code 0."""
    df = read_indexed_csv(spark, path, schemas.STATE_DIM_HEADER, schemas.STATE_DIM)
    return real_states(df)


def real_states(state_dim: DataFrame) -> DataFrame:
    return state_dim.filter(F.col("state_fips") > 0)


def read_county_dim(spark: SparkSession, path: str) -> DataFrame:
    return read_indexed_csv(spark, path, schemas.COUNTY_DIM_HEADER, schemas.COUNTY_DIM)


def county_labels(county_dim: DataFrame) -> DataFrame:
    return county_dim.select("state_fips", "fips", "area_name")


def read_indicator(spark: SparkSession, path: str, category: str) -> DataFrame:
    """One wide indicator table."""
    names = catalog.indicator(category).measures.values()
    header = {**schemas.INDICATOR_HEADER, **{m: m for m in names}}
    schema = StructType([schemas.COUNTY_DIM["fips"]]
                        + [StructField(m, DoubleType()) for m in names])
    df = read_indexed_csv(spark, path, header, schema)
    return df.withColumns({m: areas.number_or_null(F.col(f"`{m}`")) for m in names})


def read_indicators(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four indicator tables by category."""
    return {i.category: read_indicator(spark, f"{folder}/{i.file}.csv", i.category)
            for i in catalog.INDICATORS}


def indicators_long(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union(indicators.to_long(df, category) for category, df in tables.items())


def read_signal(spark: SparkSession, path: str, name: str,
                newest_only: bool | None = None) -> DataFrame:
    """One clean signal: valid values, and only the latest per county for a running total."""
    raw = read_indexed_csv(spark, path, schemas.SIGNAL_HEADER, schemas.SIGNAL)
    signal = clean.valid_values(raw.withColumn("signal", F.lit(name)))
    signal = signal.select(schemas.SIGNAL.names)
    newest_only = catalog.is_cumulative(name) if newest_only is None else newest_only
    return stats.latest(signal, ("signal", "fips")) if newest_only else signal


def read_signals(spark: SparkSession, folder: str, shown_only: bool = True) -> DataFrame:
    """All signals in one table, told apart by name."""
    return _union(read_signal(spark, f"{folder}/{s.file}_fips.csv", s.name)
                  for s in catalog.SIGNALS if s.shown or not shown_only)


def read_signal_raw(spark: SparkSession, path: str) -> DataFrame:
    """A signal as fetched; columns beyond the four known ones are dropped."""
    raw = _named_csv(spark, path, {f.name: f.name for f in schemas.SIGNAL_RAW})
    return raw.select(*[F.trim(f.name).try_cast(f.dataType).alias(f.name)
                        for f in schemas.SIGNAL_RAW])


def read_signals_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {s.name: read_signal_raw(spark, f"{folder}/{s.file}.csv") for s in catalog.SIGNALS}


def read_sheet_csv(spark: SparkSession, path: str, columns: Mapping[str, str], preamble: int,
                   key: str) -> DataFrame:
    """Chosen columns of an exported sheet with ``preamble`` lines above its header, as text.

    ``columns`` maps sheet headers to names; ``key`` is the name of a column that is numeric in
    every data row, which tells data from the lines above it.
    """
    chosen = _named_csv(spark, path, columns, preamble)
    return chosen.filter(F.trim(F.col(key)).try_cast("double").isNotNull())


def read_indicator_sheet(spark: SparkSession, path: str, category: str) -> DataFrame:
    """An indicator table from its exported sheet."""
    spec = catalog.indicator(category)
    columns = {**dict(zip(spec.keys, catalog.AREA_KEYS)), **spec.measures}
    df = read_sheet_csv(spark, path, columns, spec.preamble, "fips")
    return df.select(
        _whole(F.col("fips")).alias("fips"), "state_abrv", "area_name",
        *[F.trim(F.col(f"`{m}`")).try_cast("double").alias(m) for m in spec.measures.values()])


def read_state_sheet(spark: SparkSession, path: str) -> DataFrame:
    # Header texts and preamble of the state sheet.
    columns = {"State (FIPS)": "state_fips", "Name": "name"}
    df = read_sheet_csv(spark, path, columns, 5, "state_fips")
    return df.select(_whole(F.col("state_fips")).alias("state_fips"), "name")


def read_county_sheet(spark: SparkSession, path: str) -> DataFrame:
    # Header texts and preamble of the area sheet.
    columns = {"Summary Level": "summary_level", "State Code (FIPS)": "state_fips",
               "County Code (FIPS)": "county_fips",
               "Area Name (including legal/statistical area description)": "area_name"}
    df = read_sheet_csv(spark, path, columns, 4, "summary_level")
    return df.select(_whole(F.col("summary_level")).cast("int").alias("summary_level"),
                     _whole(F.col("state_fips")).alias("state_fips"),
                     _whole(F.col("county_fips")).alias("county_fips"), "area_name")


def read_tweet_text(spark: SparkSession, path: str | list[str], state: str | None = None) -> DataFrame:
    """One text per line; the state is the name of the file, as far as it is a postal code."""
    lines = spark.read.text(path).select(_file_state().alias("state"), F.col("value").alias("text"))
    return lines if state is None else lines.filter(F.col("state") == state)


def read_filed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with the file's stem as the state, be it a name or a code."""
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1)
    return spark.read.text(path).select(F.url_decode(stem).alias("state"),
                                        F.col("value").alias("text"))


def read_tweet_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Ids of the files right inside a folder; lines that are no number are left out."""
    ids = spark.read.text(path).select(_file_state().alias("state"),
                                       areas.parse_long(F.col("value")).alias("id"))
    return ids.filter(F.col("id").isNotNull())


def read_embeds(spark: SparkSession, folder: str, state: str | None = None) -> DataFrame:
    """One saved embed per file, one folder per state.

    Spark is given the folders: with a pattern over files, each file would be a path of its own, looked up by
    the driver and listed by a task.
    """
    pattern = f"{folder}/{state or '*'}"
    files = spark.read.text(storage.folders(spark, pattern) or f"{pattern}/*", wholetext=True)
    path_state = F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)
    return files.select(path_state.alias("state"), tweet_fn.embed_lines(F.col("value")).alias("html"))


def read_tweets_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(schemas.TWEET).json(path)


def _file_state():
    return F.nullif(F.regexp_extract("_metadata.file_name", r"^([A-Z]{2})\.txt$", 1), F.lit(""))


def _whole(text):
    """Sheets may export whole numbers with a decimal point."""
    return F.trim(text).try_cast("double").try_cast("bigint")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    parts = iter(parts)
    whole = next(parts)
    for part in parts:
        whole = whole.unionByName(part)
    return whole
