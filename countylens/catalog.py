"""Names the reports are asked for by: signals, indicators, states, presets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AREA_KEYS = ("fips", "state_abrv", "area_name")


@dataclass(frozen=True)
class Signal:
    name: str
    source: str
    signal: str
    file: str
    shown: bool = True

    @property
    def is_cumulative(self) -> bool:
        return is_cumulative(self.name)


@dataclass(frozen=True)
class Indicator:
    category: str
    file: str
    sheet: str
    preamble: int
    keys: tuple[str, str, str]
    measures: dict[str, str]


@dataclass(frozen=True)
class Preset:
    state: str
    category: str | None = None
    measure: str | None = None
    signal: str | None = None


# Display name, provider, provider's signal name, file stem.
SIGNALS = (
    Signal("Cumulative Cases per 100K people", "usa-facts", "confirmed_cumulative_prop",
           "confirmed_cumulative_cases_prop"),
    Signal("Daily New Cases per 100K people", "usa-facts", "confirmed_incidence_prop",
           "confirmed_daily_incidence_cases_prop"),
    Signal("Cumulative Deaths per 100K people", "usa-facts", "deaths_cumulative_prop",
           "cumulative_deaths_prop"),
    Signal("Daily Deaths per 100K people", "usa-facts", "deaths_incidence_prop",
           "daily_incidence_deaths_prop"),
    Signal("Daily % Covid-Related Doctor Visits", "doctor-visits", "smoothed_adj_cli",
           "perc_covid_doctor_visits"),
    Signal("% People Wearing Masks in Public in Past 5 Days", "fb-survey", "smoothed_wearing_mask",
           "perc_people_wearing_masks"),
    Signal("% People Tested for Covid in Past 14 Days", "fb-survey", "smoothed_tested_14d",
           "perc_people_tested"),
    Signal("% Positive Covid Tests in Past 14 Days", "fb-survey", "smoothed_tested_positive_14d",
           "perc_positive_tests"),
    Signal("% People not Tested who Wanted Tests", "fb-survey", "smoothed_wanted_test_14d",
           "perc_wanted_test"),
    Signal("completely_home_prop", "safegraph", "completely_home_prop",
           "completely_home_prop", shown=False),
)

# File stem, sheet, preamble rows, key columns, measure column -> display name.
INDICATORS = (
    Indicator("Poverty", "poverty_2018", "PovertyEstimates", 4,
              ("FIPStxt", "Stabr", "Area_name"),
              {"PCTPOVALL_2018": "% Total Population in Poverty (2018)",
               "PCTPOV017_2018": "% Children Ages 0-17 in Poverty (2018)"}),
    Indicator("Unemployment and Median HHI", "unemployment_median_hhi_2018", "Unemployment", 7,
              ("FIPStxt", "Stabr", "area_name"),
              {"Unemployment_rate_2018": "% Unemployment (2018)",
               "Median_Household_Income_2018": "Median Household Income (2018)",
               "Med_HH_Income_Percent_of_State_Total_2018":
                   "Median Household Income % of State Total (2018)"}),
    Indicator("Population", "population_2018", "PopulationEstimates", 2,
              ("FIPStxt", "State", "Area_Name"),
              {"POP_ESTIMATE_2018": "Population Estimate (2018)"}),
    Indicator("Education", "education_2018", "Education", 4,
              ("FIPS Code", "State", "Area name"),
              {"Percent of adults with less than a high school diploma, 2014-18":
                   "% Adults Incomplete High School (2018)",
               "Percent of adults with a high school diploma only, 2014-18":
                   "% Adults Complete High School (2018)",
               "Percent of adults completing some college or associate's degree, 2014-18":
                   "% Adults Some College (2018)",
               "Percent of adults with a bachelor's degree or higher, 2014-18":
                   "% Adults Complete College (2018)"}),
)

# State name -> postal code.
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL",
    "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY",
    "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Puerto Rico": "PR", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT",
    "Virgin Islands": "VI", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV",
    "Wisconsin": "WI", "Wyoming": "WY",
}

# Common English words left out of word counts.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()

# What each guided view asks for.
PRESETS = {
    "Narrative Population": Preset("Florida", "Population", "Population Estimate (2018)",
                                   "Cumulative Cases per 100K people"),
    "Narrative Education": Preset("Florida", "Education", "% Adults Incomplete High School (2018)",
                                  "Cumulative Cases per 100K people"),
    "Narrative Median HHI": Preset("Florida", "Unemployment and Median HHI",
                                   "Median Household Income (2018)",
                                   "Cumulative Cases per 100K people"),
    "Narrative Tweets": Preset("Florida"),
}

# What is shown when nothing is chosen.
DEFAULTS = Preset("Pennsylvania", "Poverty", "% Total Population in Poverty (2018)",
                  "Cumulative Cases per 100K people")
DEFAULT_STATISTIC = "Max"
TOP_WORDS = 50
DEFAULT_DAYS = 7


def is_cumulative(name: str) -> bool:
    """Signals with this word in their name report a running total: only the latest row counts."""
    return "cumulative" in name.lower()


def signal(name: str) -> Signal:
    return next(s for s in SIGNALS if s.name == name)


def indicator(category: str) -> Indicator:
    return next(i for i in INDICATORS if i.category == category)


def measures(df: DataFrame) -> list[str]:
    """Measure columns of an indicator table: all but its keys."""
    return [c for c in df.columns if c not in AREA_KEYS]


def state_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATE_CODES.items()), "name string, code string")


def signals_table(spark: SparkSession) -> DataFrame:
    """The signal catalogue as rows, in display order."""
    rows = [(i, s.name, s.source, s.signal, s.file, s.is_cumulative, s.shown)
            for i, s in enumerate(SIGNALS)]
    return spark.createDataFrame(
        rows, "position int, name string, source string, signal string, file string, "
              "is_cumulative boolean, shown boolean")


def indicators_table(spark: SparkSession) -> DataFrame:
    """Every indicator measure as a row, in display order."""
    rows = [(i, ind.category, measure)
            for i, ind in enumerate(INDICATORS) for measure in ind.measures.values()]
    return spark.createDataFrame(rows, "position int, category string, measure string")
