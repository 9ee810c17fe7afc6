"""The driver's tables seen as area, signal, indicator and text tables.

Every view is defined twice, as a DataFrame and as SQL. An id k stands for the area in state
k % 25 with county number (k / 25 + k % 25) % 1000: one state total, otherwise distinct counties.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from countylens import catalog, schemas
from countylens.functions import areas, stems, texts
from countylens.operators import clean, indicators
from countylens.operators.lookup import one_row_per_code
from countylens.plans import etl, reports
from countylens.sources import readers

CASES = "Cumulative Cases per 100K people"
DEATHS = "Cumulative Deaths per 100K people"
CODES = list(catalog.STATE_CODES.values())
NAMES = list(catalog.STATE_CODES)
# Endings given to texts in turn, so that links, contractions, marks and filtered words occur.
ENDINGS = (
    " https://a.com/x COVID don't",
    " see http://t.co/Ab1 now b.org people's cannot",
    " HTTPS://A.COM gonna we'll... coronavirus",
    " rt @user: #StayHome -- \"quoted\" (word)",
    " don’t “quarantine” 10:30 p.m.",
    "",
    " wait.... work, work; \"stay\"?",
)


def area_parts(key: Column) -> tuple[Column, Column]:
    state = key % 25
    return state, (F.call_function("div", key, F.lit(25)) + state) % 1000


def area_of(key: str) -> Column:
    return areas.fips(*area_parts(F.col(key)))


class Data:
    """Views for one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def state_dim(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("state_fips"),
                                           F.col("n_name").alias("name"))

    @cached_property
    def county_sheet(self) -> DataFrame:
        states = self.table("nation").select(
            F.lit(40).alias("summary_level"), F.col("n_nationkey").cast("bigint").alias("state_fips"),
            F.lit(0).cast("bigint").alias("county_fips"), F.col("n_name").alias("area_name"))
        state, county = area_parts(F.col("s_suppkey"))
        counties = self.table("supplier").select(
            F.lit(50).alias("summary_level"), state.alias("state_fips"),
            county.alias("county_fips"), F.col("s_name").alias("area_name"))
        return states.unionByName(counties)

    @cached_property
    def county_dim(self) -> DataFrame:
        built = etl.build_county_dim(self.county_sheet, readers.real_states(self.state_dim))
        return one_row_per_code(built).select(schemas.COUNTY_DIM.names)

    def _lineitem(self, value: Column) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        return self.table("lineitem").select(
            area_of("l_suppkey").alias("geo_value"), day.alias("time_value"),
            F.date_add(day, F.col("l_linenumber")).alias("issue"), value.alias("value"))

    @cached_property
    def cases_raw(self) -> DataFrame:
        return self._lineitem(F.col("l_quantity") - 5)

    @cached_property
    def deaths_raw(self) -> DataFrame:
        return self._lineitem(F.col("l_extendedprice"))

    @cached_property
    def daily_raw(self) -> DataFrame:
        day = F.col("ts").cast("date")
        return self.table("events").select(
            area_of("user_id").alias("geo_value"), day.alias("time_value"),
            F.date_add(day, 1).alias("issue"), (F.col("value") - 5).alias("value"),
            F.col("event_type").alias("signal"))

    @cached_property
    def cases(self) -> DataFrame:
        return etl.build_signal(self.cases_raw, self.county_dim, CASES)

    @cached_property
    def deaths(self) -> DataFrame:
        return etl.build_signal(self.deaths_raw, self.county_dim, DEATHS)

    @cached_property
    def daily(self) -> DataFrame:
        return etl.build_signal(self.daily_raw, self.county_dim)

    def daily_of(self, name: str) -> DataFrame:
        return self.daily.filter(F.col("signal") == name)

    @cached_property
    def signals(self) -> DataFrame:
        return self.cases.unionByName(self.deaths).unionByName(self.daily)

    def _indicator(self, table: str, key: str, name: str, category: str,
                   *values: Column) -> DataFrame:
        measures = catalog.indicator(category).measures.values()
        wide = self.table(table).select(
            area_of(key).alias("fips"), (F.col(key) % 25).cast("string").alias("state_abrv"),
            F.col(name).alias("area_name"),
            *[v.cast("double").alias(m) for v, m in zip(values, measures, strict=True)])
        return one_row_per_code(wide)

    @cached_property
    def poverty(self) -> DataFrame:
        return self._indicator("supplier", "s_suppkey", "s_name", "Poverty",
                               F.col("s_acctbal"), F.col("s_suppkey") % 17)

    @cached_property
    def unemployment(self) -> DataFrame:
        balance = F.col("c_acctbal")
        return self._indicator("customer", "c_custkey", "c_name", "Unemployment and Median HHI",
                               balance / 2, F.col("c_custkey") % 13,
                               F.when(balance < 0, F.lit(float("nan"))).otherwise(balance))

    @cached_property
    def population(self) -> DataFrame:
        return self._indicator("customer", "c_custkey", "c_name", "Population", F.col("c_acctbal"))

    @cached_property
    def education(self) -> DataFrame:
        return self._indicator("part", "p_partkey", "p_name", "Education", F.col("p_retailprice"),
                               F.col("p_size"), F.col("p_partkey") % 101, F.lit(7))

    @cached_property
    def indicators(self) -> dict[str, DataFrame]:
        return {"Poverty": self.poverty, "Unemployment and Median HHI": self.unemployment,
                "Population": self.population, "Education": self.education}

    @cached_property
    def indicator_long(self) -> DataFrame:
        return readers.indicators_long(self.indicators)

    @cached_property
    def documents(self) -> DataFrame:
        place = F.substring("source", F.lit(4), F.length("source")).cast("int")
        return self.table("documents").withColumn("_s", place)

    @cached_property
    def tweet_text(self) -> DataFrame:
        endings = F.array(*[F.lit(e) for e in ENDINGS])
        ending = F.element_at(endings, (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
        return self.documents.select(
            "doc_id", _pick(CODES).alias("state"),
            F.concat(texts.one_line(F.col("text")), ending).alias("text"))

    @cached_property
    def tweets(self) -> DataFrame:
        s, turn, text = F.col("_s"), F.col("doc_id") % 3, F.col("text")
        name = (F.when(s % 3 == 0, F.concat(_pick(NAMES), F.lit(", USA")))
                .when(s % 4 == 1, "Town, Country").otherwise(F.concat(F.lit("City, "), _pick(CODES))))
        place = F.struct(
            F.when(s % 7 == 3, "CA").otherwise("US").alias("country_code"),
            F.when(s % 3 == 0, "admin").otherwise("city").alias("place_type"),
            name.alias("full_name"))
        return self.documents.select(
            F.col("doc_id").alias("id"), "lang", F.when(s % 5 != 0, place).alias("place"),
            F.when(turn == 0, F.struct(text.alias("full_text"))).alias("retweeted_status"),
            F.when(turn == 0, F.concat(F.lit("RT "), "source")).when(turn == 1, text)
            .alias("full_text"),
            F.when(turn == 2, text).alias("text"))

    @cached_property
    def filed_lines(self) -> DataFrame:
        filed = F.when(F.col("doc_id") % 2 == 0, _pick(NAMES)).otherwise(_pick(CODES))
        return self.documents.select(filed.alias("state"), "doc_id")

    @cached_property
    def embeds(self) -> DataFrame:
        html = F.concat(
            F.lit('<blockquote class="twitter-tweet"><p lang="'), "lang", F.lit('" dir="ltr">'),
            "text", F.lit("</p>&mdash; Name "), "source", F.lit(" (@"), "source",
            F.lit(') <a href="https://twitter.com/'), "source", F.lit("/status/"),
            F.col("doc_id").cast("string"), F.lit('?ref_src=x">April 10, 2020</a></blockquote>'))
        saved = self.documents.select(_pick(CODES).alias("state"), html.alias("html"))
        return saved.unionByName(self.table("pages").select(
            F.lit(None).cast("string").alias("state"), "html"))

    def report_tables(self) -> reports.Tables:
        return reports.Tables(self.state_dim, self.county_dim, clean.valid_values(self.signals),
                              self.indicators,
                              self.tweet_text)


def _pick(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_s") + 1)


# ---------------------------------------------------------------------------------------------
# The same views in SQL
# ---------------------------------------------------------------------------------------------

def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def list_sql(values) -> str:
    return "[" + ", ".join(text_sql(v) for v in values) + "]"


def area_sql(key: str) -> str:
    return f"(({key} % 25) * 1000 + ({key} // 25 + {key} % 25) % 1000)"


def newest_sql(view: str, keys: str = "fips") -> str:
    """The latest row per key of a signal view."""
    return (f"(SELECT * FROM {view} QUALIFY row_number() OVER (PARTITION BY {keys} "
            "ORDER BY time_value DESC, issue DESC, value DESC) = 1)")


def pearson_sql(x: str = "value", y: str = "measure_value") -> str:
    """Correlation, null where a side does not vary."""
    return (f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END")


def tokens_sql(text: str) -> str:
    spaced = f"lower(regexp_replace({text}, {text_sql(texts.URL)}, ' ', 'g'))"
    for pattern, replacement in texts.SPLIT_RULES:
        spaced = f"regexp_replace({spaced}, {text_sql(pattern)}, {text_sql(replacement)}, 'g')"
    return f"list_filter(string_split_regex({spaced}, '\\s+'), lambda t: t <> '')"


def counted_word_sql(word: str = "word", stopwords=catalog.STOPWORDS) -> str:
    tests = [f"length({word}) > 3", f"{word} NOT IN ('rt', 'http', 'https')",
             f"NOT starts_with({word}, '//t.co')", f"NOT ends_with({word}, '...')",
             f"NOT contains({word}, 'corona')", f"NOT contains({word}, 'covid')"]
    if stopwords:
        tests.append(f"{word} NOT IN ({', '.join(text_sql(w) for w in stopwords)})")
    return " AND ".join(tests)


def letter_tokens_sql(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), {text_sql(texts.LETTER_RUN)}, 1), "
            "lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'))")


def stem_sql(source: str) -> str:
    """Words of a query with their base forms: the steps of the cascade as queries inside each other."""
    def size(text):
        return f"length({text})"

    def stripped(step):
        whens = []
        for r in step:
            stem = f"left(w, length(w) - {len(r.ending)})"
            holds = ([f"{size(stem)} >= r{r.region}"] if r.region else []) + (
                [f"regexp_matches({stem}, {text_sql(r.before)})"] if r.before else [])
            other = "w" if r.otherwise is None else f"{stem} || {text_sql(r.otherwise)}"
            new = "w" if r.becomes is None else f"{stem} || {text_sql(r.becomes)}"
            new = f"CASE WHEN {' AND '.join(holds)} THEN {new} ELSE {other} END" if holds else new
            whens.append(f"WHEN ends_with(w, {text_sql(r.ending)}) THEN {new}")
        return f"CASE {' '.join(whens)} ELSE w END"

    def step(sql, w, more=""):
        return f"SELECT * REPLACE ({w} AS w){more} FROM ({sql})"

    unless = "CASE WHEN stays THEN w ELSE {} END"
    sql = (f"SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({stems.VOWEL})y', '\\1Y', 'g') AS w "
           f"FROM ({source})")
    sql = step(sql, stripped(stems.POSSESSIVE))
    sql = f"SELECT *, {size(f'regexp_extract(w, {text_sql(f"^({stems.PREFIXES})|{stems.BEFORE_REGION}")}, 0)')} AS f FROM ({sql})"
    sql = f"SELECT *, CASE WHEN f > 0 THEN f ELSE length(w) END AS r1 FROM ({sql})"
    sql = f"SELECT *, {size(f'regexp_extract(substr(w, r1 + 1), {text_sql(stems.BEFORE_REGION)}, 0)')} AS g FROM ({sql})"
    sql = f"SELECT *, CASE WHEN g > 0 THEN r1 + g ELSE length(w) END AS r2 FROM ({sql})"
    sql = step(sql, stripped(stems.PLURAL))
    sql = f"SELECT *, w IN ({', '.join(map(text_sql, stems.STAY))}) AS stays, {stripped(stems.PAST)} AS p FROM ({sql})"
    mended = (f"CASE WHEN regexp_matches(p, '(at|bl|iz)$') THEN p || 'e' WHEN regexp_matches(p, '({'|'.join(stems.DOUBLES)})$') "
              f"THEN left(p, length(p) - 1) WHEN length(p) <= r1 AND regexp_matches(p, {text_sql(stems.SHORT)}) "
              "THEN p || 'e' ELSE p END")
    sql = step(sql, unless.format(f"CASE WHEN length(w) - length(p) > 1 AND NOT regexp_matches(w, 'eed(ly)?$') THEN {mended} ELSE p END"))
    for rules in (stems.LAST_Y, stems.LONG, stems.MIDDLE, stems.SHORTER):
        sql = step(sql, unless.format(stripped(rules)))
    stem = "left(w, length(w) - 1)"
    sql = step(sql, unless.format(
        f"CASE WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT "
        f"regexp_matches({stem}, {text_sql(stems.SHORT)})) THEN {stem} ELSE w END ELSE {stripped([stems.LAST_L])} END"))
    special = " ".join(f"WHEN word = {text_sql(a)} THEN {text_sql(b)}" for a, b in stems.SPECIAL.items())
    return (f"SELECT word, CASE WHEN length(word) <= 2 THEN word {special} ELSE translate(w, 'Y', 'y') END AS base "
            f"FROM ({sql})")


def title_sql(name: str) -> str:
    runs = f"regexp_extract_all(lower({name}), '(\\p{{L}}+|\\P{{L}}+)')"
    return (f"array_to_string(list_transform({runs}, "
            "lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '')")


def text_of_sql() -> str:
    return ("replace(replace(coalesce(retweet_text, full_text, text, ''), chr(10), ''), "
            "chr(13), '')")


STATE_OF_PLACE_SQL = (
    "CASE WHEN place_type = 'admin' THEN trim(string_split(full_name, ',')[1]) "
    "WHEN length(trim(string_split(full_name, ',')[-1])) = 2 "
    "THEN trim(string_split(full_name, ',')[-1]) END")


def _measure(category: str, position: int) -> str:
    return list(catalog.indicator(category).measures.values())[position]


def _wide_sql(table: str, key: str, name: str, category: str, *values: str) -> str:
    names = list(catalog.indicator(category).measures.values())
    picked = ", ".join(f'CAST({v} AS DOUBLE) AS "{m}"' for v, m in zip(values, names, strict=True))
    order = ", ".join(f'"{m}" DESC' for m in names)
    return (f"SELECT {area_sql(key)} AS fips, CAST({key} % 25 AS VARCHAR) AS state_abrv, "
            f"{name} AS area_name, {picked} FROM {table} QUALIFY row_number() OVER "
            f"(PARTITION BY fips ORDER BY state_abrv DESC, area_name DESC, {order}) = 1")


def _long_sql(category: str, view: str) -> str:
    parts = [f"SELECT {text_sql(category)} AS category, fips, {text_sql(m)} AS measure, "
             f"CASE WHEN isnan(\"{m}\") THEN NULL ELSE \"{m}\" END AS measure_value FROM {view}"
             for m in catalog.indicator(category).measures.values()]
    return " UNION ALL ".join(parts)


def _lineitem_sql(value: str) -> str:
    return (f"SELECT {area_sql('l_suppkey')} AS geo_value, CAST(l_shipdate AS DATE) AS time_value, "
            f"CAST(l_shipdate AS DATE) + l_linenumber AS issue, {value} AS value FROM lineitem")


def _signal_sql(raw: str, name: str) -> str:
    return (f"SELECT {name} AS signal, r.geo_value AS fips, r.time_value, r.issue, r.value, "
            f"c.state_name, c.area_name FROM {raw} r LEFT JOIN county_dim c "
            "ON r.geo_value = c.fips WHERE r.geo_value % 1000 <> 0")


_CODE = f"{list_sql(CODES)}[s + 1]"
_NAME = f"{list_sql(NAMES)}[s + 1]"

VIEWS = {
    "state_dim": "SELECT CAST(n_nationkey AS BIGINT) AS state_fips, n_name AS name FROM nation",
    "county_sheet":
        "SELECT 40 AS summary_level, CAST(n_nationkey AS BIGINT) AS state_fips, "
        "CAST(0 AS BIGINT) AS county_fips, n_name AS area_name FROM nation UNION ALL "
        "SELECT 50, s_suppkey % 25, (s_suppkey // 25 + s_suppkey % 25) % 1000, s_name FROM supplier",
    "county_built":
        "SELECT c.state_fips, c.county_fips, c.state_fips * 1000 + c.county_fips AS fips, "
        f"s.name AS state_name, {title_sql('c.area_name')} AS area_name FROM county_sheet c "
        "LEFT JOIN (SELECT * FROM state_dim WHERE state_fips > 0) s USING (state_fips) "
        "WHERE c.summary_level = 50",
    "county_dim":
        "SELECT * FROM county_built QUALIFY row_number() OVER (PARTITION BY fips ORDER BY "
        "state_fips DESC, county_fips DESC, state_name DESC, area_name DESC) = 1",
    "map_areas": "SELECT fips, area_name FROM county_dim WHERE fips % 1000 <> 0",
    "cases_raw": _lineitem_sql("l_quantity - 5"),
    "deaths_raw": _lineitem_sql("l_extendedprice"),
    "daily_raw":
        f"SELECT {area_sql('user_id')} AS geo_value, CAST(ts AS DATE) AS time_value, "
        "CAST(ts AS DATE) + 1 AS issue, value - 5 AS value, event_type AS signal FROM events",
    "cases": _signal_sql("cases_raw", text_sql(CASES)),
    "deaths": _signal_sql("deaths_raw", text_sql(DEATHS)),
    "daily": _signal_sql("daily_raw", "r.signal"),
    "signals": "SELECT * FROM cases UNION ALL SELECT * FROM deaths UNION ALL SELECT * FROM daily",
    "valid_cases": "SELECT * FROM cases WHERE value >= 0 AND NOT isnan(value)",
    "valid_signals": "SELECT * FROM signals WHERE value >= 0 AND NOT isnan(value)",
    "poverty": _wide_sql("supplier", "s_suppkey", "s_name", "Poverty", "s_acctbal",
                         "s_suppkey % 17"),
    "unemployment": _wide_sql("customer", "c_custkey", "c_name", "Unemployment and Median HHI",
                              "c_acctbal / 2", "c_custkey % 13",
                              "CASE WHEN c_acctbal < 0 THEN 'nan'::DOUBLE ELSE c_acctbal END"),
    "population": _wide_sql("customer", "c_custkey", "c_name", "Population", "c_acctbal"),
    "education": _wide_sql("part", "p_partkey", "p_name", "Education", "p_retailprice", "p_size",
                           "p_partkey % 101", "7"),
    "indicator_long": " UNION ALL ".join(
        _long_sql(c, v) for c, v in (("Poverty", "poverty"),
                                     ("Unemployment and Median HHI", "unemployment"),
                                     ("Population", "population"), ("Education", "education"))),
    "documents_s": "SELECT *, CAST(substr(source, 4) AS INTEGER) AS s FROM documents",
    "tweet_text":
        f"SELECT doc_id, {_CODE} AS state, replace(replace(text, chr(10), ''), chr(13), '') || "
        f"{list_sql(ENDINGS)}[doc_id % {len(ENDINGS)} + 1] AS text FROM documents_s",
    "tweets":
        "SELECT doc_id AS id, lang, s % 5 <> 0 AS has_place, "
        "CASE WHEN s % 5 <> 0 THEN CASE WHEN s % 7 = 3 THEN 'CA' ELSE 'US' END END AS country_code, "
        "CASE WHEN s % 5 <> 0 THEN CASE WHEN s % 3 = 0 THEN 'admin' ELSE 'city' END END "
        "AS place_type, "
        f"CASE WHEN s % 5 <> 0 THEN CASE WHEN s % 3 = 0 THEN {_NAME} || ', USA' "
        f"WHEN s % 4 = 1 THEN 'Town, Country' ELSE 'City, ' || {_CODE} END END AS full_name, "
        "CASE WHEN doc_id % 3 = 0 THEN text END AS retweet_text, "
        "CASE doc_id % 3 WHEN 0 THEN 'RT ' || source WHEN 1 THEN text END AS full_text, "
        "CASE WHEN doc_id % 3 = 2 THEN text END AS text FROM documents_s",
    "filed_lines":
        f"SELECT CASE WHEN doc_id % 2 = 0 THEN {_NAME} ELSE {_CODE} END AS state, doc_id "
        "FROM documents_s",
    "embeds":
        f"SELECT {_CODE} AS state, '<blockquote class=\"twitter-tweet\"><p lang=\"' || lang || "
        "'\" dir=\"ltr\">' || text || '</p>&mdash; Name ' || source || ' (@' || source || "
        "') <a href=\"https://twitter.com/' || source || '/status/' || doc_id || "
        "'?ref_src=x\">April 10, 2020</a></blockquote>' AS html FROM documents_s "
        "UNION ALL SELECT NULL, html FROM pages",
    "counted_words":
        f"SELECT * FROM (SELECT doc_id, state, unnest({tokens_sql('text')}) AS word "
        f"FROM tweet_text) WHERE {counted_word_sql()}",
    "state_counts":
        "SELECT state, word, count(*) AS count FROM counted_words GROUP BY state, word",
    "bag":
        "SELECT doc_id, word, count(*) AS count FROM (SELECT doc_id, "
        f"unnest({letter_tokens_sql('text')}) AS word FROM documents) "
        f"WHERE length(word) > 3 AND word NOT IN "
        f"({', '.join(text_sql(w) for w in catalog.STOPWORDS)}) GROUP BY doc_id, word",
    "lexicon":
        "SELECT DISTINCT word, regexp_replace(word, '(ing|ed|s)$', '') AS base FROM bag "
        "WHERE regexp_matches(word, '(ing|ed|s)$') "
        "AND regexp_replace(word, '(ing|ed|s)$', '') IN (SELECT word FROM bag)",
}


def with_views(body: str) -> str:
    """SQL over the views, with those it needs in front."""
    import re
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed) + " " + body
