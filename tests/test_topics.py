import random
import time
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from countylens import storage
from countylens.catalog import STOPWORDS
from countylens.functions import measures
from countylens.operators import topics


@pytest.fixture(scope="module")
def docs(spark):
    sports = "Goals goals scored! Teams scoring goals while teams played"
    food = "bread butter bread cheese butter; eating bread2 cheese"
    return spark.createDataFrame([(i, sports if i % 2 else food) for i in range(20)],
                                 "doc_id long, text string")


def test_bag(docs):
    bag = {(r.doc_id, r.word): r["count"] for r in topics.bag_of_words(docs, stopwords=STOPWORDS).collect()}
    assert bag[1, "goals"] == 3 and bag[0, "bread"] == 3
    assert (1, "while") not in bag


def test_normalize(docs, spark):
    lexicon = spark.createDataFrame([("goals", "goal"), ("scored", "score"), ("scoring", "score")],
                                    "word string, base string")
    bag = topics.normalize(topics.bag_of_words(docs, stopwords=STOPWORDS), lexicon)
    rows = {(r.doc_id, r.word): r["count"] for r in bag.collect()}
    assert rows[1, "goal"] == 3 and rows[1, "score"] == 2 and rows[1, "teams"] == 2


def test_vocabulary(docs):
    rows = topics.vocabulary(topics.bag_of_words(docs, stopwords=STOPWORDS)).orderBy("word_id").collect()
    assert [(r.word_id, r.word, r["count"]) for r in rows[:3]] == [
        (0, "bread", 30), (1, "goals", 30), (2, "butter", 20)]


def test_model_finds_both_topics(docs):
    bag = topics.bag_of_words(docs, stopwords=STOPWORDS)
    model = topics.fit(bag, topics=2, passes=20, seed=1)
    described = topics.describe(model, 3)
    rows = described.collect()
    assert len(rows) == 6 and {r["rank"] for r in rows} == {1, 2, 3}
    tops = {r.topic: r.word for r in rows if r["rank"] == 1}
    assert sorted(tops.values()) == ["bread", "goals"]
    line = topics.topic_lines(described).orderBy("topic").first().words
    assert line.count(" + ") == 2 and '*"' in line
    shares = {(r.doc_id % 2, r.topic): r.share for r in topics.assign(bag, model).collect()}
    assert len(shares) == 4 and shares[0, 0] + shares[0, 1] == pytest.approx(1)
    food = next(t for t, w in tops.items() if w == "bread")
    assert shares[0, food] > 0.9 and shares[1, food] < 0.1


def test_vectors(docs):
    bag = topics.bag_of_words(docs, stopwords=STOPWORDS)
    terms = topics.vocabulary(bag)
    row = topics.vectors(bag, terms).filter("doc_id = 0").first()
    words = {r.word_id: r.word for r in terms.collect()}
    assert row.word_ids == sorted(row.word_ids)
    assert {words[w]: n for w, n in zip(row.word_ids, row.counts)} == {"bread": 3, "butter": 2, "cheese": 2, "eating": 1}


def plain_fit(rows, words, topics, passes, start):
    """Variational Bayes text by text, as the textbook has it."""
    prior, weights = 1 / topics, start.copy()
    for _ in range(passes):
        factors = np.exp(topics_module.digamma(weights) - topics_module.digamma(weights.sum(axis=0)))
        new = np.full_like(weights, prior)
        for counts in rows.values():
            ids = np.array([words.index(w) for w in counts])
            n = np.array(list(counts.values()), float)
            gamma = np.full(topics, prior + n.sum() / topics)
            for _ in range(topics_module.SWEEPS):
                theta = np.exp(topics_module.digamma(gamma))
                share = theta * factors[ids]
                share /= share.sum(axis=1, keepdims=True)
                last, gamma = gamma, prior + n @ share
                if np.abs(gamma - last).mean() <= topics_module.SETTLED:
                    break
            share = np.exp(topics_module.digamma(gamma)) * factors[ids]
            share /= share.sum(axis=1, keepdims=True)
            np.add.at(new, ids, n[:, None] * share)
        weights = new
    return weights


topics_module = topics


@pytest.mark.parametrize("held", [1 << 16, 7])
def test_fit_is_as_by_hand(spark, monkeypatch, held):
    """The same weights as a plain loop over texts, also where a task takes a few words at a time."""
    monkeypatch.setattr(topics, "HELD", held)
    rng = random.Random(3)
    rows = {k: {f"w{rng.randrange(25)}": rng.randint(1, 4) for _ in range(rng.randint(1, 12))} for k in range(40)}
    rows[None] = {"w1": 2, "w3": 1}
    bag = spark.createDataFrame([(k, w, n) for k, c in rows.items() for w, n in c.items()],
                                "doc_id long, word string, count long").repartition(5)
    first = topics.fit(bag, topics=3, passes=0, seed=4)
    named = {r.word: r.weights for r in first.weights.collect()}
    words = sorted(named)
    want = plain_fit(rows, words, 3, 4, np.array([named[w] for w in words]))
    model = topics.fit(bag, topics=3, passes=4, seed=4)
    got = {r.word: r.weights for r in model.weights.collect()}
    assert np.allclose([got[w] for w in words], want, rtol=1e-6, atol=1e-8)
    assert np.allclose(model.totals, want.sum(axis=0))


def test_fit_by_batches(docs, tmp_path, spark):
    """Steps on halves of the texts; a saved model is read back whole."""
    bag = topics.bag_of_words(docs, stopwords=STOPWORDS)
    model = topics.fit(bag, topics=2, passes=20, batch=0.5, seed=2)
    again = topics.fit(bag.repartition(3), topics=2, passes=20, batch=0.5, seed=2)
    assert sorted(map(str, topics.describe(model, 3).select("topic", "word").collect())) == sorted(
        map(str, topics.describe(again, 3).select("topic", "word").collect()))
    model.save(str(tmp_path / "m"))
    back = topics.load(spark, str(tmp_path / "m"))
    assert back.totals == pytest.approx(model.totals) and back.weights.count() == model.weights.count()


def test_fit_of_nothing(spark):
    bag = spark.createDataFrame([], "doc_id long, word string, count long")
    model = topics.fit(bag, passes=1)
    assert topics.describe(model).count() == 0 and topics.assign(bag, model).count() == 0


def test_digamma(spark):
    """The recurrence, known values, and the same numbers from Spark and numpy."""
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.0, 7.5, 1e6])
    assert np.allclose(topics.digamma(x + 1) - topics.digamma(x), 1 / x)
    assert topics.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)
    frame = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = [r[0] for r in frame.select(measures.digamma(F.col("v"))).collect()]
    assert np.allclose(got, topics.digamma(x), rtol=1e-9)


def test_a_million_words_stay_off_the_driver(spark, plan):
    """A model of a million words: no vocabulary in the model's own memory, tables all the way."""
    n = 1_000_000
    bag = spark.range(n).select((F.col("id") % 1000).alias("doc_id"),
                                F.concat(F.lit("word"), F.col("id").cast("string")).alias("word"),
                                F.lit(1).cast("bigint").alias("count"))
    model = topics.fit(bag, topics=3, passes=1)
    assert model.weights.count() == n and len(model.totals) == 3
    text = plan(topics.describe(model))
    assert "WindowGroupLimit" in text and "LocalTableScan" not in text
    assert topics.describe(model).count() == 30


def test_weights_travel_by_block(spark, monkeypatch):
    """Texts in many blocks give the same model as in one, and a word has one row of factors in each block."""
    rows = [(k, f"w{(k * j) % 11}", j) for k in range(300) for j in range(1, 5)]
    bag = (spark.createDataFrame(rows, "doc_id long, word string, count long")
           .groupBy("doc_id", "word").agg(F.sum("count").alias("count")))
    whole = topics.fit(bag, topics=3, passes=2, seed=1)
    shares = {(r.doc_id, r.topic): r.share for r in topics.assign(bag, whole).collect()}
    by_block = topics._by_block
    counted = []

    def watched(rows, uses, factors):
        blocks = rows.select("_block").distinct().count()
        counted.append((blocks, uses.count(), rows.count()))
        return by_block(rows, uses, factors)

    monkeypatch.setattr(topics, "BLOCK", 100)
    monkeypatch.setattr(topics, "_by_block", watched)
    split = topics.fit(bag, topics=3, passes=2, seed=1)
    named = {r.word: r.weights for r in whole.weights.collect()}
    assert all(np.allclose(r.weights, named[r.word]) for r in split.weights.collect())
    assert {(r.doc_id, r.topic) for r in topics.assign(bag, split).collect()} == set(shares) and len(shares) == 900
    for blocks, uses, size in counted:
        assert 5 < blocks and uses <= 11 * blocks < size


def test_bag_is_found_once(spark):
    """A fit reads its bag once, however often it uses it."""
    seen = spark.sparkContext.accumulator(0)

    def noted(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    bag = spark.createDataFrame([(k, f"w{k % 5}", 1) for k in range(50)], "doc_id long, word string, count long")
    topics.fit(bag.mapInArrow(noted, bag.schema), topics=2, passes=2)
    assert seen.value == 50


def test_vectors_are_gathered_after_one_shuffle_by_text(spark, plan, tmp_path):
    """The vocabulary is hashed, no side of its join is sorted; lists are not built before rows lie by text.
    The query reads a bag that is stored."""
    from checks.queries import QUERIES
    from checks.tables import Data

    spark.createDataFrame([(0, "bread butter bread"), (1, "butter"), (2, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = QUERIES["word_vectors"](Data(spark, str(tmp_path)))
    text = plan(found)
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    assert "REPARTITION_BY_COL" in text and text.index("collect_list") < text.index("REPARTITION_BY_COL")
    assert text.rindex("collect_list") < text.index("REPARTITION_BY_COL") and "regexp_extract_all" not in text
    assert {(r.doc_id, r.words) for r in found.collect()} == {(0, "0:2 1:1"), (1, "1:1")}


def test_model_query_finds_its_bag_once(spark, monkeypatch, tmp_path):
    from checks import queries
    from checks.tables import Data

    calls, bag = [], queries._bag
    monkeypatch.setattr(queries, "_bag", lambda d: calls.append(1) or bag(d))
    words = " ".join(f"word{c}" for c in "abcdefghijkl")
    spark.createDataFrame([(0, words.replace("word", "")), (1, " ".join(f"name{c} names" for c in "abcdefghijkl"))],
                          "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["topic_model"](Data(spark, str(tmp_path))).collect()
    assert len(calls) == 1 and len(rows) == 10 and {r.words for r in rows} == {10}


def test_texts_travel_packed(spark, monkeypatch):
    """A step takes a row per text, of a byte or two for each word and for each count, not a row per word."""
    bag = spark.range(3000).select((F.col("id") % 30).alias("doc_id"), F.concat(
        F.lit("word"), F.col("id").cast("string")).alias("word"), F.lit(1).cast("bigint").alias("count"))
    by_block, seen = topics._by_block, []

    def watched(rows, uses, factors):
        seen.append((rows.count(), rows.agg(F.sum(F.octet_length("places") + F.octet_length("counts"))).first()[0]))
        return by_block(rows, uses, factors)

    monkeypatch.setattr(topics, "_by_block", watched)
    topics.fit(bag, topics=2, passes=2)
    assert [rows for rows, _ in seen] == [30, 30] and all(3000 * 2 <= size < 3000 * 4 for _, size in seen)


def test_blocks_normalized_are_as_rows_normalized(spark, monkeypatch):
    """Base forms put in the words of blocks give the model and shares of base forms put in rows; words and texts
    that are null, counts that are large or no whole numbers are kept."""
    monkeypatch.setattr(topics, "BLOCK", 40)
    rng = random.Random(5)
    pairs = {(rng.choice([None, *range(20)]), rng.choice(["goal", "goals", "scored", "score", "scoring", "team", None])): 0
             for _ in range(200)}
    lexicon = spark.createDataFrame([("goals", "goal"), ("scored", "score"), ("scoring", "score")], "word string, base string")
    for kind, counts in (("bigint", [1, 2, 200, 1 << 33]), ("double", [0.5, 1.25, 300.0])):
        bag = spark.createDataFrame([(k, w, rng.choice(counts)) for k, w in pairs], f"doc_id long, word string, count {kind}")
        plain = topics.normalize(bag, lexicon)
        held = topics.normalize(topics.blocked(bag), lexicon)
        rows, blocks = (topics.fit(b, topics=2, passes=2, seed=1) for b in (plain, held))
        want = {r.word: r.weights for r in rows.weights.collect()}
        got = {r.word: r.weights for r in blocks.weights.collect()}
        assert set(got) == set(want) == {"goal", "score", "team", None}
        assert all(np.allclose(got[w], want[w], rtol=1e-6) for w in want)
        shares = [{(r.doc_id, r.topic): r.share for r in topics.assign(b, rows).collect()} for b in (plain, held)]
        assert shares[0].keys() == shares[1].keys() and (None, 0) in shares[0]
        assert all(shares[1][k] == pytest.approx(v, rel=1e-6) for k, v in shares[0].items())


def test_blocks_fit_their_batches(spark):
    bag = spark.createDataFrame([(0, "goal", 1)], "doc_id long, word string, count long")
    with pytest.raises(ValueError, match="1 batches"):
        topics.fit(topics.blocked(bag), batch=0.5)


def test_packed_lists_are_read_back():
    values = np.array([0, 127, 128, 1 << 40, -1, 5, 5, (1 << 63) - 1])
    data, bounds = topics._bytes(topics.pa.chunked_array([topics._packed(values, np.array([0, 2, 5])).slice(1)]))
    assert list(topics._unpacked(data)) == list(values[2:]) and len(bounds) == 3


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in held for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_what_a_step_shuffled_is_removed(spark, tmp_path):
    """Files that were shuffled for a stored table go when it is written, not when the driver collects its garbage."""
    before = shuffle_files(spark)
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert storage.staged(rows, str(tmp_path / "t")).count() == 7
    for _ in range(50):
        left = {f for f in shuffle_files(spark) - before if f.stat().st_size > 1000}
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(storage.CLEANUP, None) in (None, "false")


def test_shares_query_stores_its_bag_once(spark, monkeypatch, tmp_path):
    """The model and the shares use the same blocks: rows of the bag are written out once."""
    from checks.queries import QUERIES
    from checks.tables import Data

    stored, staged = [], storage.staged
    monkeypatch.setattr(storage, "staged", lambda df, path, *more: stored.append(path) or staged(df, path, *more))
    spark.createDataFrame([(0, "bread butter bread"), (1, "butter"), (2, None), (None, "cheese")],
                          "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["topic_shares"](Data(spark, str(tmp_path))).collect()
    assert {(r.doc_id, r.topics, r.whole) for r in rows} == {(0, 10, True), (1, 10, True), (None, 10, True)}
    assert sum(path.endswith("/bag") for path in stored) == 1
