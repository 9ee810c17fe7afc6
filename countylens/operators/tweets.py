"""Selecting tweets and sorting them by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countylens import catalog
from countylens.functions import tweets as fn


def english(tweets: DataFrame) -> DataFrame:
    return tweets.filter(fn.is_english(F.col("lang")))


def us_english(tweets: DataFrame) -> DataFrame:
    return tweets.filter(fn.is_english(F.col("lang")) & fn.is_in_us(F.col("place")))


def texts(tweets: DataFrame) -> DataFrame:
    """Ids and one-line texts."""
    return tweets.select("id", _text())


def by_state(tweets: DataFrame, state: str | None = None) -> DataFrame:
    """Ids and texts of English tweets from the US with their state, each from its own place.

    A given state holds for all tweets; otherwise those without a readable state are left out.
    """
    named = F.lit(state) if state else fn.state_of_place(F.col("place"))
    return (us_english(tweets).select(named.alias("state"), "id", _text())
            .filter(F.col("state").isNotNull()))


def _text():
    return fn.text_of(F.col("full_text"), F.col("retweeted_status.full_text"),
                      F.col("text")).alias("text")


def consolidate_states(rows: DataFrame, state: str = "state") -> DataFrame:
    """Rows filed under a state's name move to its postal code; other rows stay.

    The code table is a fixed list of 53 states.
    """
    codes = F.broadcast(catalog.state_codes(rows.sparkSession)).withColumnRenamed("name", "_name")
    return (rows.join(codes, F.col(state) == F.col("_name"), "left")
            .withColumn(state, F.coalesce("code", state)).select(rows.columns))


def unseen(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """New rows whose key is not stored, once each. Stored ones go before anything is compared."""
    others = [c for c in new.columns if c != key]
    fresh = new.join(stored.select(key), key, "left_anti")
    if not others:
        return fresh.distinct()
    return (fresh.groupBy(key).agg(F.max(F.struct(*others)).alias("_row"))
            .select(key, "_row.*").select(new.columns))


def embed_fields(embeds: DataFrame) -> DataFrame:
    """Status id, author, handle, day and language of saved embeds."""
    html = F.col("html")
    fields = [fn.embed_field(html, name).alias(name) for name in fn.EMBED_FIELDS]
    return embeds.select("state", *fields).withColumn(
        "status_id", F.col("status_id").cast("bigint"))
