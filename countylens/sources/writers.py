"""Writers. File sizes follow the data: adaptive rebalancing joins small and splits large
partitions, a hot state included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from countylens.operators import tweets


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                sort_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A table, optionally in folders by some columns and ordered by others, so that later filters
    on either skip data: an ordered table is dealt by ranges, and no two of its files overlap."""
    if sort_by:
        df = df.repartitionByRange(*partition_by, *sort_by).sortWithinPartitions(
            *partition_by, *sort_by)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_by_state(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Rows added to a folder per state. Every run writes files of its own names."""
    write_table(df.withColumn("run_ts", F.current_timestamp()), path, fmt, ("state",),
                mode="append")


def append_unseen(df: DataFrame, stored: DataFrame | None, path: str, key: str = "id",
                  fmt: str = "parquet") -> None:
    """As ``append_by_state``, without the rows whose key is stored already or comes twice."""
    if stored is None:
        stored = df.select(key).filter(F.lit(False))
    append_by_state(tweets.unseen(df, stored, key), path, fmt)


def write_consolidated(lines: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Lines filed by state name or code, all under the code."""
    write_table(tweets.consolidate_states(lines), path, fmt, ("state",))
