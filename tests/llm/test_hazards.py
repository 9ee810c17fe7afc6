"""Columns of any name, nulls in every column, repeated rows and long texts, through every operator."""

import random

import pytest
from pyspark.sql import functions as F

from countylens.llm import (fingerprints, language, lexicon, mixing, near_dups, quality, substrings,
                            token_counts, toxicity)

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("word_bpe_49k.json")
CLASHES = ("__i", "__t", "__s", "__n", "__hits", "__firsts", "node", "n", "copies", "x", "toxic", "h",
           "size", "rate", "tie", "c0", "c1", "a.b", "TEXT2", "component_id")


@pytest.fixture(scope="module")
def docs(spark):
    pick = random.Random(11)
    long = " ".join(f"w{pick.randrange(10 ** 6)}" for _ in range(60_000))
    rows = [(k, " ".join(f"v{pick.randrange(50)}" for _ in range(30)), f"s{k % 2}", "en")
            for k in range(30)]
    rows += [rows[3], rows[3], (50, long, "s0", "en"), (51, long, "s1", "fr"), (52, None, None, None),
             (53, "", "s0", None), (None, None, None, None), (None, "no id", None, "en"),
             (None, "no id", None, "en"), (54, "½ ²", "s0", "en")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    return frame.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n)
                               for n in CLASHES]).repartition(3)


def extras(frame):
    return sorted(str(tuple(r)[4:]) for r in frame.collect())


def test_columns_come_through(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (3, None)],
                                   "doc_id bigint, toxic int")
    whole = set(extras(docs))
    for out in (near_dups.dedup(docs), substrings.dedup(docs), mixing.mixed(docs),
                toxicity.clean(docs, labels)):
        assert out.columns == docs.columns
        assert set(extras(out)) <= whole
    assert extras(substrings.dedup(docs)) == extras(docs)
    kept = {r.doc_id for r in near_dups.dedup(docs).collect()}
    assert 50 in kept and 51 not in kept and {52, 53, None} <= kept


def test_a_row_for_every_row(docs):
    n = docs.count()
    learned = language.learn(docs, key=F.col("doc_id"))
    found = language.predicted(docs, learned)
    assert {r.lang_pred for r in found.filter("doc_id in (52, 53, 54)").collect()} == {"und"}
    for out in (found, mixing.mix(docs), token_counts.token_counts(docs, VOCABULARY),
                fingerprints.with_next(docs), substrings.digest(docs), quality.judged(docs),
                near_dups.near_duplicates(docs), lexicon.encoded(docs, VOCABULARY, digests=True)):
        assert out.count() == n


def test_calibration_does_not_depend_on_the_order(docs):
    known = docs.filter("doc_id < 30 or doc_id is null")
    _, *one = language.learn(known, key=F.col("doc_id"), calibrate=2)
    _, *two = language.learn(known.repartition(5, "text"), key=F.col("doc_id"), calibrate=2)
    assert one == two
