"""What a user asks for. Every report is one lazy DataFrame, or a few over the same points."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from countylens import catalog
from countylens.functions import areas, measures
from countylens.operators import clean, indicators, stats, words
from countylens.operators.lookup import area_join, map_lookup

State = int | Column | None


@dataclass(frozen=True)
class Tables:
    """The clean tables reports read. ``signals`` holds all signals by name."""
    state_dim: DataFrame
    county_dim: DataFrame
    signals: DataFrame
    indicators: dict[str, DataFrame]
    tweet_text: DataFrame | None = None

    def signal(self, name: str) -> DataFrame:
        return self.signals.filter(F.col("signal") == name)


@dataclass(frozen=True)
class Scatter:
    """Points of a correlation plot and what is drawn around them."""
    points: DataFrame
    correlation: DataFrame
    line: DataFrame
    extents: DataFrame


def state_named(state_dim: DataFrame, name: str) -> Column:
    """The code of a state, looked up when the query runs."""
    return state_dim.filter(F.col("name") == name).agg(F.max("state_fips").alias("c")).scalar()


def map_areas(county_dim: DataFrame, state: State = None) -> DataFrame:
    """The areas a map shows, with or without data."""
    return clean.in_state(clean.county_rows(county_dim), state).select("fips", "area_name")


def indicator_map(county_dim: DataFrame, indicator: DataFrame, measure: str,
                  state: State = None) -> DataFrame:
    rows = clean.in_state(clean.county_rows(indicator), state)
    features = indicators.measure_of(rows, measure, "value")
    return map_lookup(map_areas(county_dim, state), features, "value")


def in_range(signal: DataFrame, state: State = None, first: date | None = None,
             last: date | None = None) -> DataFrame:
    """A state's rows between two days; in the last days of the whole signal if none are given."""
    rows = clean.in_state(signal, state)
    if first is None or last is None:
        return clean.in_default_range(rows, span=signal)
    return clean.date_range(rows, first, last)


def signal_map(county_dim: DataFrame, signal: DataFrame,
               statistic: str = catalog.DEFAULT_STATISTIC, state: State = None,
               first: date | None = None, last: date | None = None) -> DataFrame:
    """A statistic of a daily signal over a range of days, per area."""
    features = stats.range_stat(in_range(signal, state, first, last), statistic)
    return map_lookup(map_areas(county_dim, state), features.select("fips", "value"), "value")


def cumulative_map(county_dim: DataFrame, signal: DataFrame, state: State = None) -> DataFrame:
    """The latest value of a running total, per area."""
    features = stats.latest(clean.in_state(signal, state))
    return map_lookup(map_areas(county_dim, state),
                      features.select("fips", "value", "time_value", "issue"), "value")


def scatter(signal: DataFrame, indicator: DataFrame, measure: str, state: State = None,
            counties: Iterable[int] | DataFrame | None = None, empty: str = "all",
            refit: bool = False) -> Scatter:
    """A running total against an indicator.

    The correlation and the axes are those of all counties; chosen counties narrow the points, and
    the line only with ``refit``.
    """
    newest = stats.latest(clean.in_state(signal, state)).select("fips", "area_name", "value")
    of_state = clean.in_state(clean.county_rows(indicator), state)
    full = area_join(newest, indicators.measure_of(of_state, measure))
    shown = full if counties is None else clean.select_counties(full, counties, empty)
    return Scatter(shown, stats.correlation(full),
                   stats.regression_line(shown if refit else full), stats.extents(full))


def correlation_title(scatter_report: Scatter, signal: str, measure: str) -> DataFrame:
    return scatter_report.correlation.select(
        measures.correlation_title(signal, measure, F.col("correlation")).alias("title"))


def as_of(signal: DataFrame) -> DataFrame:
    """The day a running total stands for, as text."""
    return signal.agg(areas.as_of_label(F.max("time_value")).alias("as_of"))


def time_series(signal: DataFrame, state: State = None, first: date | None = None,
                last: date | None = None, counties: Iterable[int] | DataFrame | None = None,
                empty: str = "none") -> DataFrame:
    """Daily values of chosen counties, in order."""
    rows = in_range(signal, state, first, last).select("fips", "area_name", "time_value", "value")
    if counties is not None:
        rows = clean.select_counties(rows, counties, empty)
    return rows.orderBy("fips", "time_value", "value")


def top_words(tweet_text: DataFrame, state: str | None = None, n: int = catalog.TOP_WORDS,
              stopwords: Iterable[str] = catalog.STOPWORDS) -> DataFrame:
    """The most frequent words in the texts of a state code, or in all texts."""
    rows = tweet_text if state is None else tweet_text.filter(F.col("state") == state)
    return words.top_words(words.word_counts(words.words(rows, stopwords=stopwords)), n)


def preset(tables: Tables, name: str) -> Scatter | DataFrame:
    """A guided view: a correlation in a state, or the words of its texts."""
    chosen = catalog.PRESETS[name] if name != "Manual" else catalog.DEFAULTS
    if chosen.measure is None:
        return top_words(tables.tweet_text, catalog.STATE_CODES[chosen.state])
    return scatter(tables.signal(chosen.signal), tables.indicators[chosen.category],
                   chosen.measure, state_named(tables.state_dim, chosen.state))
