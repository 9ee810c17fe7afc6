"""Expressions on tweet objects and saved embeds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from countylens.functions.texts import one_line

# Where an embed holds its fields.
EMBED_FIELDS = {
    "status_id": r"/status/(\d+)",
    "author": r"&mdash; ([^<]*?) \(@",
    "handle": r"&mdash; [^<]*?\(@(\w+)\)",
    "posted": r"/status/[^\"]*\">([^<]+)</a></blockquote>",
    "lang": r"lang=\"([^\"]*)\"",
}


def is_english(lang: Column) -> Column:
    return lang == "en"


def is_in_us(place: Column) -> Column:
    return place.isNotNull() & (place["country_code"] == "US")


def state_of_place(place: Column) -> Column:
    """State a place lies in: first part of an admin area's name, else a two-letter last part."""
    parts = F.split(place["full_name"], ",")
    last = F.trim(F.element_at(parts, -1))
    return (F.when(place["place_type"] == "admin", F.trim(F.element_at(parts, 1)))
            .when(F.length(last) == 2, last))


def text_of(tweet_full: Column, retweet_full: Column, short: Column) -> Column:
    """The whole text, a retweet's original first, on one line."""
    return one_line(F.coalesce(retweet_full, tweet_full, short, F.lit("")))


def embed_field(html: Column, field: str) -> Column:
    """A field of a saved embed, null where it has none."""
    return F.nullif(F.regexp_extract(html, EMBED_FIELDS[field], 1), F.lit(""))


def embed_lines(html: Column) -> Column:
    """An embed as it is shown: an empty line after every line but the last."""
    return F.regexp_replace(html, r"\r?\n(?!\z)", "\n\n")
