import pytest

from countylens import schemas
from countylens.operators import sampling, tweets


def place(kind, name, country="US"):
    return (country, kind, name)


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        (1, "en", place("city", "Miami, FL"), None, "plain\ntext\r!", None),
        (2, "en", place("admin", "Florida, USA"), ("original, whole",), "RT cut…", None),
        (3, "en", place("city", "Toronto, Ontario"), None, None, "short"),
        (4, "en", place("city", "Paris, FR", "FR"), None, "abroad", None),
        (5, "es", place("city", "Miami, FL"), None, "hola", None),
        (6, "en", None, None, "nowhere", None),
        (7, "en", place("city", "Reno, NV"), None, None, None),
        (8, "en", place("city", "Los Angeles , CA "), None, "spaced", None),
    ]
    return spark.createDataFrame(rows, schemas.TWEET).cache()


def test_english_and_us(some):
    assert [r.id for r in tweets.english(some).collect()] == [1, 2, 3, 4, 6, 7, 8]
    assert [r.id for r in tweets.us_english(some).collect()] == [1, 2, 3, 7, 8]


def test_texts(some):
    got = {r.id: r.text for r in tweets.texts(some).collect()}
    assert got[1] == "plaintext!" and got[2] == "original, whole"
    assert got[3] == "short" and got[7] == ""


def test_state_comes_from_each_tweets_own_place(some):
    got = {r.id: r.state for r in tweets.by_state(some).collect()}
    assert got == {1: "FL", 2: "Florida", 7: "NV", 8: "CA"}


def test_given_state_holds_for_all(some):
    assert {r.state for r in tweets.by_state(some, "PR").collect()} == {"PR"}


def test_consolidation(spark, plan):
    lines = spark.createDataFrame([("Florida", "a"), ("FL", "b"), ("Puerto Rico", "c"), ("XX", "d"),
                                   (None, "e")], "state string, text string")
    merged = tweets.consolidate_states(lines)
    assert {(r.state, r.text) for r in merged.collect()} == {
        ("FL", "a"), ("FL", "b"), ("PR", "c"), ("XX", "d"), (None, "e")}
    assert "BroadcastHashJoin" in plan(merged)


def test_unseen_ids_once(spark):
    new = spark.createDataFrame([("FL", 1), ("FL", 1), ("CA", 2), ("CA", 3)], "state string, id long")
    stored = spark.createDataFrame([("CA", 2), ("CA", 2)], "state string, id long")
    assert sorted(map(tuple, tweets.unseen(new, stored).collect())) == [("CA", 3), ("FL", 1)]
    assert sorted(r.id for r in tweets.unseen(new.select("id"), stored).collect()) == [1, 3]


def test_embed_fields(spark):
    html = ('<blockquote class="twitter-tweet"><p lang="en" dir="ltr">Hi <a href="https://t.co/x">'
            'https://t.co/x</a></p>&mdash; Some One (@some_1) <a href="https://twitter.com/some_1/'
            'status/123456789012345678?ref_src=z">April 10, 2020</a></blockquote>\n<script></script>')
    df = spark.createDataFrame([("FL", html), ("FL", "<p>none</p>")], "state string, html string")
    rows = tweets.embed_fields(df).collect()
    assert tuple(rows[0]) == ("FL", 123456789012345678, "Some One", "some_1", "April 10, 2020", "en")
    assert tuple(rows[1]) == ("FL", None, None, None, None, None)


def test_share_of_ids():
    assert sampling.id_fraction() == pytest.approx(0.0002)
    assert sampling.id_fraction(1) == 1.0 and sampling.id_fraction(0.9) == 1.0


def test_bernoulli(spark):
    ids = spark.range(20_000)
    assert sampling.bernoulli(ids, 1) is ids
    drawn = sampling.bernoulli(ids, 0.1, seed=3)
    assert 1700 < drawn.count() < 2300


def test_sample_by_key_ignores_partitioning(spark):
    ids = spark.range(20_000)
    one = {r.id for r in sampling.by_key(ids, "id", 0.1).collect()}
    two = {r.id for r in sampling.by_key(ids.repartition(13), "id", 0.1).collect()}
    assert one == two and 1700 < len(one) < 2300
    assert one != {r.id for r in sampling.by_key(ids, "id", 0.1, seed=1).collect()}
    assert one < {r.id for r in sampling.by_key(ids, "id", 0.2).collect()}
    assert sampling.by_key(ids, "id", 1) is ids


def test_sample_per_group(spark, plan):
    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' else 's' || id % 7 end g")
    drawn = sampling.per_group(df, ("g",), "id", 2)
    assert plan(drawn).count("WindowGroupLimit") == 2
    rows = drawn.collect()
    assert len(rows) == 16 and len({r.g for r in rows}) == 8
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sampling.per_group(
        df.repartition(9), ("g",), "id", 2).collect()))
