"""Counting and ranking words. Input is any DataFrame with a text column, batch or stream."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from countylens import catalog, storage
from countylens.functions import texts


def words(df: DataFrame, text: str = "text", keep: Sequence[str] = (),
          stopwords: Iterable[str] = catalog.STOPWORDS) -> DataFrame:
    """One row per counted word, next to the kept columns."""
    chunks = (df.select(*keep, F.explode(texts.chunks(F.col(text))).alias("_chunk"))
              .filter(F.length("_chunk") >= texts.MIN_LETTERS))
    return (chunks.select(*keep, F.explode(texts.pieces(F.col("_chunk"))).alias("word"))
            .filter(texts.is_counted_word(F.col("word"), stopwords)))


def drop_stopwords(words_df: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Words not in a stopword table of any size.

    Best given counted words: then each word is one row, and no hot word is shuffled.
    """
    return words_df.join(stopwords.select("word"), "word", "left_anti").select(*words_df.columns)


def word_counts(words_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per word; a hot word is summed up before the shuffle."""
    return words_df.groupBy(*by, "word").agg(F.count("*").alias("count"))


def top_words(counts: DataFrame, n: int = catalog.TOP_WORDS) -> DataFrame:
    """The most frequent words; equal counts in word order."""
    return counts.orderBy(F.desc("count"), "word").limit(n)


def top_words_by(counts: DataFrame, by: Sequence[str] = ("state",),
                 n: int = catalog.TOP_WORDS) -> DataFrame:
    """The most frequent words of each group, ranked. Each task sends at most n words per group."""
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def word_ranks(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rank of every word by count, equal counts in word order, within each group or overall.

    A group's vocabulary is never brought together. Words are dealt by sampled ranges of the final order,
    (group, count falling, word), whatever counts or letters they share, sorted once, numbered in
    place and written out. Each group's stretch of a range then needs only the number of its words in the ranges
    before: a small table, a row per range and group in it. The words are written so that all uses
    see the same ranges. Groups are named by structs, which are never null, so a missing group counts
    as one.
    """
    order = [*by, F.desc("count"), "word"]
    folder = storage.work_folder(counts.sparkSession, "ranks")
    sorted_ = counts.select(*by, "word", "count").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = storage.staged(sorted_.withColumn("_place", F.monotonically_increasing_id()), folder).withColumn(
        "_stretch", F.struct(F.shiftright("_place", 33).alias("range"), *by))
    stretches = placed.groupBy("_stretch").agg(F.count("*").alias("_words"), F.min("_place").alias("_first"))
    group = F.struct(*[F.col("_stretch").getField(c) for c in by]) if by else F.lit(0)
    earlier = Window.partitionBy(group).orderBy("_stretch.range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_words").over(earlier) - F.col("_words") - F.col("_first") + 1
    offsets = stretches.select("_stretch", before.alias("_before"))
    return (placed.join(offsets, "_stretch").withColumn("rank", F.col("_place") + F.col("_before"))
            .select(*by, "word", "count", "rank"))


def shared_top_words(counts: DataFrame, n: int = catalog.TOP_WORDS) -> DataFrame:
    """In how many states' top words each word appears."""
    return (top_words_by(counts, ("state",), n)
            .groupBy("word").agg(F.countDistinct("state").alias("states")))
