import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from countylens import catalog
from countylens.operators import words


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(3)
    letters = "abcdé"
    rows = {(rng.choice(["FL", "CA", "NY"]),
             "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))): rng.randint(1, 6)
            for _ in range(800)}
    data = [(s, w, n) for (s, w), n in rows.items()]
    return data, spark.createDataFrame(data, "state string, word string, count long").cache()


def ranked(rows):
    order = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    return {w: i + 1 for i, (w, _) in enumerate(order)}


def test_ranks_within_states(counts):
    data, df = counts
    want = {}
    for state in ("FL", "CA", "NY"):
        for word, rank in ranked([(w, n) for s, w, n in data if s == state]).items():
            want[state, word] = rank
    got = {(r.state, r.word): r["rank"] for r in words.word_ranks(df, ("state",)).collect()}
    assert got == want


def test_ranks_overall(counts, spark):
    data, _ = counts
    total = Counter()
    for _, w, n in data:
        total[w] += n
    df = spark.createDataFrame(list(total.items()), "word string, count long")
    got = {r.word: r["rank"] for r in words.word_ranks(df).collect()}
    assert got == ranked(list(total.items()))


def test_missing_state_is_a_group(spark):
    df = spark.createDataFrame([(None, "a", 2), (None, "b", 3), ("FL", "a", 1)],
                               "state string, word string, count long")
    got = {(r.state, r.word): r["rank"] for r in words.word_ranks(df, ("state",)).collect()}
    assert got == {(None, "b"): 1, (None, "a"): 2, ("FL", "a"): 1}


def test_top_words_ties_in_word_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", 1)], "word string, count long")
    assert [r.word for r in words.top_words(df, 3).collect()] == ["c", "a", "b"]


def test_top_words_by_state_limit_before_the_shuffle(counts, plan):
    data, df = counts
    top = words.top_words_by(df, n=4)
    assert plan(top).count("WindowGroupLimit") == 2
    got = {(r.state, r.word): r["rank"] for r in top.collect()}
    for state in ("FL", "CA", "NY"):
        ranks = ranked([(w, n) for s, w, n in data if s == state])
        assert {w: r for w, r in ranks.items() if r <= 4} == {
            w: r for (s, w), r in got.items() if s == state}


def test_shared_top_words(spark):
    df = spark.createDataFrame([("FL", "work", 5), ("CA", "work", 4), ("CA", "home", 9),
                                ("NY", "home", 1), ("NY", "rare", 0)],
                               "state string, word string, count long")
    got = {r.word: r.states for r in words.shared_top_words(df, 1).collect()}
    assert got == {"work": 1, "home": 2}


def test_counts_add_up_to_kept_words(spark):
    texts = spark.createDataFrame(
        [("FL", "Stay home stay HOME work https://a.com #Covid19 don't"), ("FL", None), ("CA", "")],
        "state string, text string")
    found = words.words(texts, keep=("state",))
    counted = words.word_counts(found, ("state",)).collect()
    assert {(r.state, r.word): r["count"] for r in counted} == {
        ("FL", "stay"): 2, ("FL", "home"): 2, ("FL", "work"): 1}
    assert sum(r["count"] for r in counted) == found.count()


def test_stopword_table(spark):
    found = spark.createDataFrame([("home",), ("just",), (None,)], "word string")
    stop = spark.createDataFrame([(w,) for w in catalog.STOPWORDS], "word string")
    assert [r.word for r in words.drop_stopwords(found, stop).collect()
            if r.word] == ["home"]


def test_words_of_one_count_and_beginning_are_spread(spark):
    """100,000 words of one count that share 30 letters are dealt over all ranges and ranked right."""
    n = 100_000
    counts = spark.range(n).select(F.format_string("a" * 30 + "%09d", "id").alias("word"),
                                   F.lit(1).cast("bigint").alias("count"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = words.word_ranks(counts)
        rows = ranked.agg(F.count_if(F.col("rank") == F.substring("word", 31, 9).cast("bigint") + 1)
                          .alias("right"), F.count("*").alias("all")).first()
        placed = ranked._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert rows == (n, n) and "_place" in placed
    folder = next(f for f in ranked.inputFiles())
    written = spark.read.parquet(folder.rsplit("/", 1)[0])
    sizes = [r["count"] for r in written.groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < n / 4


def test_ranks_with_missing_groups_and_none(spark):
    rows = [(None, "b", 2), (None, "a", 2), ("x", "a", 1), ("", "a", 9), ("", None, 9)]
    ranked = words.word_ranks(spark.createDataFrame(rows, "state string, word string, count long"), ("state",))
    assert {(r.state, r.word): r["rank"] for r in ranked.collect()} == {
        (None, "a"): 1, (None, "b"): 2, ("x", "a"): 1, ("", None): 1, ("", "a"): 2}
    assert words.word_ranks(spark.createDataFrame([], "word string, count long")).count() == 0
