"""Mixing, chats, the pipeline, and the registered queries."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from countylens.llm import chat, mixing

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    """The stated rule, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: list(map(ord, s)))
    order += [None] if None in sizes else []
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, out = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in out]
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        out |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)


def found_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    return {r.source: r.target for r in mixing.targets(mixing.sources(rows)).collect()}


def test_targets(spark):
    sizes = {"b": 100, "a": 1000, None: 10, "c": 400}
    want = found_targets(spark, sizes)  # a, b, c, null weigh 5, 2, 1, 5
    assert want["b"] == 200 and want[None] == 20 and sum(want.values()) == pytest.approx(1.5 * 1510)
    assert want["a"] / want["c"] == pytest.approx(5)
    assert found_targets(spark, {"a": 0}) == {"a": 0.0}
    pick = random.Random(8)
    for n in (3, 40, 3000):
        sizes = {"é%d" % k if k % 3 else "\U0001F600%d" % k: int(10 ** (5 * pick.random())) for k in range(n)}
        sizes[None] = 7
        assert found_targets(spark, sizes) == pytest.approx(plain_targets(sizes))


def test_equal_rows_do_not_miss_the_target(spark):
    """Half of a source are copies of one row."""
    rows = [(1, "w " * 30, "a")] * 3000 + [(k, "w " * (1 + k % 60), "a") for k in range(2, 3002)]
    rows += [(None, "x y", "b")] * 900 + [(None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(9)
    out = mixing.mix(df).groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"),
        F.max("copies").alias("most")).collect()
    assert {r.source: r.n for r in out} == {"a": 6000, "b": 900, None: 1}
    for r in out:
        assert abs(r.taken - r.target) <= 60 and r.most <= 2
    assert mixing.mixed(df).filter("source = 'a'").agg(
        F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == [r.taken for r in out if r.source == "a"][0]


@pytest.fixture(scope="module")
def docs(spark):
    pick = random.Random(3)
    rows = [(k, " ".join(["w"] * pick.randrange(1, 60)), "s%d" % (k % 3 and k % 7), "k")
            for k in range(1500)]
    rows += [(None, "a b", None, "k"), (9000, None, "s1", "k"), (9001, "", "s1", "k"), (5, rows[5][1], rows[5][2], "k")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1504
    taken, largest = {}, {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for r in rows:
        assert abs(taken[r.source] - r.target) <= 2 * largest[r.source]
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_rows(docs):
    rows = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == rows
    assert mixing.mixed(docs.filter("false")).count() == 0


def test_expectation_is_kept():
    """Over many seeds each document is taken as often as its fraction says."""
    import numpy as np

    size, x = np.array([3, 10, 7, 2, 5]), np.full(5, 0.3)
    group, key = np.zeros(5), np.arange(5, dtype=np.uint64)
    total, words = np.zeros(5), []
    for seed in range(4000):
        out = mixing.pivot(group, size, x, mixing.coins(seed, 0, key))
        assert ((out > 0) & (out < 1)).sum() <= 1
        words.append((out * size).sum())
        total += out
    assert np.allclose(total / 4000, 0.3, atol=0.04) and np.allclose(words, 0.3 * size.sum())


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_chat_round_trip(spark):
    told = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", told), (1, 0, "user", told), (2, 0, None, None), (2, 1, "a]b[\\", "\\e\\l]<s>"),
            (3, 0, "assistant", "é"), (3, 0, "assistant", "é"), (3, None, "assistant", "first"),
            (None, 0, "user", "x"), (4, 0, "assistant", "")]
    got = {r.conv_id: r for r in chat.digest(talk(spark, rows)).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(talk(spark, rows))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", told), ("assistant", told)]
    assert [(t.role, t.text) for t in back[2].turns] == [("", ""), ("a]b[\\", "\\e\\l]<s>")]
    assert back[3].loss_texts == ["first", "é", "é"] and back[4].loss_texts == [""]
    assert got[1].turns_sha256 == hashlib.sha256(
        f"user\n{told}\nassistant\n{told}\n".encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars) == (2, len(told)) and None in got
    assert chat.digest(talk(spark, rows).filter("false")).count() == 0


def test_events_fold(spark):
    rows = [("m1", 1, "message", "user", "hi"), ("m2", 2, "delta", "assistant", "he"),
            ("m2", 3, "delta", "assistant", "llo"), ("m2", 4, "regenerate", "assistant", "good"),
            ("m2", 5, "delta", "assistant", " day"), ("m1", 6, "edit", "user", "hello"),
            ("m3", 7, "message", "user", "gone"), ("m3", 8, "delete", "user", None)]
    events = spark.createDataFrame([(1, *r) for r in rows],
                                   "conv_id int, message string, seq int, kind string, role string, text string")
    got = chat.folded(events.repartition(3)).orderBy("place").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hello"), ("assistant", "good day")]


def test_chat_is_native(spark, plan):
    text = plan(chat.digest(talk(spark, [(1, 0, "user", "x")])))
    assert "Python" not in text and "Arrow" not in text


@given
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dups", "substring_dedup", "mix", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()


@given
@pytest.mark.parametrize("name", ["op4_substring_dedup", "op6_near_dups", "op7_chat"])
def test_queries_against_sql(spark, name):
    import duckdb

    from countylens.llm import queries

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, FOLDER).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@given
def test_every_operator_is_registered(spark):
    import __spark_entry__ as driver

    names = [n for n in driver.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in driver.queries()
