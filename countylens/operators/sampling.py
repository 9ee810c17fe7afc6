"""Random and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: share of ids to end up with; half of the drawn ids are expected to be English.
SHARE = 0.0001


def id_fraction(share: float = SHARE) -> float:
    """The share of ids to draw for a share of English texts; everything if all are wanted."""
    return 1.0 if share == 1 else min(1.0, share * 2)


def bernoulli(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Each row with the same chance, independently."""
    return df if fraction >= 1 else df.sample(False, fraction, seed)


def ticket(key: Column, seed: int = 0) -> Column:
    """A number drawn for a key, as hex digits: the same on every run and partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def by_key(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample that depends on the key alone."""
    if fraction >= 1:
        return df
    limit = format(int(fraction * 16 ** 8), "08x")
    return df.filter(F.substring(ticket(F.col(key), seed), 1, 8) < limit)


def per_group(df: DataFrame, by: Sequence[str], key: str, n: int = 1, seed: int = 0) -> DataFrame:
    """n random rows of each group. Each task sends at most n rows per group."""
    order = Window.partitionBy(*by).orderBy(ticket(F.col(key), seed), key)
    return (df.withColumn("_draw", F.row_number().over(order))
            .filter(F.col("_draw") <= n).drop("_draw"))
