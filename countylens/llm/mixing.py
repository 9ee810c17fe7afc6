"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its documents should have. The whole part is
given to all; the fraction x is rounded so that the words taken stay near the target. Two documents i, j
of a source with fractions in (0, 1) are paired and words are moved between them, from j to i or from i to
j, until one fraction is 0 or 1. Both directions keep size_i x_i + size_j x_j; which one is taken is a
coin whose odds keep both expectations. The other document goes on, with what is left, to the next
pair. Leaves of about LEAF documents are reduced this way in parallel; what is left of a leaf, at most
one document per source, moves up a tree of FAN branches until one document per source remains, which
a last coin rounds. So a source misses its target by less than one document.

Coins are hashes of seed, level and document, and leaves are hashes of the document, so reruns agree and a
lost task is repeated alike. Only keys and numbers are shuffled.

Targets come from a table of one row per source: places in code point order are numbered by ranges of that
order, and the stop is a level that rises until no source passes it, each time one aggregation. The driver
holds one number per range and a few sums, whatever the number of sources.

Of n rows with equal doc_id, text and source and fraction x, floor(n x) take one copy more, and one fraction for
what is left goes into the tree; which of the equal rows take it is told by their place in the table. A null
text has size 0, a very long one is counted whole where it lies. Documents of size 0 are rounded by a coin
of their own. An empty table gives an empty result; a mix whose sizes are all 0 has targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from countylens.llm import common as c

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
LEAF, FAN = 256, 64


def sources(rows: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): in code point order, null last, the weights in turn.

    A row's place is its place in its range of the order, behind as many as the ranges before hold.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.asc_nulls_last("source")
    dealt = c.staged(totals.repartitionByRange(order).sortWithinPartitions(order).withColumn(
        "at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    held = sorted(map(tuple, dealt.groupBy(part).count().collect()))  # one number per range
    before = np.cumsum([0] + [n for _, n in held]).tolist()
    offsets = rows.sparkSession.createDataFrame(
        [(p, b) for (p, _), b in zip(held, before)], "part bigint, before bigint")
    turn = F.pmod(F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(len(weights)))
    return dealt.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).alias("weight"))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The sources with target: share of all words by weight, none above most times its size.

    What goes beyond a stop is dealt to the others by weight. A source stops where its stop over its weight is
    below the level, the words per weight left to those that do not; as sources stop the level rises.
    """
    stop = most * F.col("source_size")

    def over(level: float) -> Column:
        return F.lit(level) * F.col("weight") > stop

    level, stopped = 0.0, -1
    while True:
        past = over(level)
        n, held, free, words = sizes.agg(
            F.count_if(past), F.sum(F.when(past, stop)), F.sum(F.when(~past, F.col("weight"))),
            F.sum("source_size")).first()
        if n == stopped or not free:
            break
        level, stopped = max(share * words - (held or 0.0), 0.0) / free, n
    return sizes.withColumn("target", F.when(over(level), stop).otherwise(F.lit(level) * F.col("weight")))


def coins(seed: int, level: int, key: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but the arguments."""
    shift = c.numbers(1000 + seed * 64 + level, 1)[0]
    return (c.mix(key.view(np.uint64) ^ shift) >> np.uint64(11)) / float(1 << 53)


def pivot(group: np.ndarray, size: np.ndarray, x: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Pairs the fractions of each run of equal groups one after another; the new fractions.

    At most one per group is not whole afterwards.
    """
    x = x.copy()
    open_ = -1
    for k in range(len(x)):
        if not 0.0 < x[k] < 1.0:
            continue
        if open_ < 0 or group[open_] != group[k]:
            open_ = k
            continue
        i, j, a, b = open_, k, size[open_], size[k]
        up = min((1 - x[i]) * a, x[j] * b)    # words from j to i
        down = min(x[i] * a, (1 - x[j]) * b)  # words from i to j
        moved = up if coin[k] * (up + down) < down else -down
        x[i], x[j] = _near(x[i] + moved / a), _near(x[j] - moved / b)
        open_ = i if 0.0 < x[i] < 1.0 else j if 0.0 < x[j] < 1.0 else -1
    return x


def _near(v: float) -> float:
    return 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v


_STATE = "source string, __i bigint, __t bigint, size bigint, x double, node bigint"


def _round(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Reduces every (node, source) of the rows; x is 0, 1, or of the one that is left a fraction."""
    def reduce(parts):
        held = None
        for part in parts:
            t = part if held is None else pa.Table.from_batches([held, part]).combine_chunks() \
                .to_batches()[0]
            node = t.column("node").to_numpy()
            source = t.column("source").to_pylist()
            change = [k for k in range(1, len(node))
                      if node[k] != node[k - 1] or source[k] != source[k - 1]]
            cut = change[-1] if change else 0
            if cut:
                yield done(t.slice(0, cut), change)
            held = t.slice(cut)
        if held is not None and len(held):
            yield done(held, [])

    def done(t, change):
        n = len(t)
        group = np.zeros(n, np.int64)
        group[[k for k in change if k < n]] = 1
        key = t.column("__i").to_numpy().view(np.uint64) ^ c.mix(
            t.column("__t").to_numpy().view(np.uint64))
        coin = coins(seed, level, key)
        size = t.column("size").to_numpy()
        x = t.column("x").to_numpy().copy()
        alone = (size == 0) & (x > 0) & (x < 1)
        x[alone] = (coin[alone] < x[alone]).astype(float)
        x = pivot(np.cumsum(group), size, x, coin)
        if last:
            half = (x > 0) & (x < 1)
            x[half] = np.round(x[half])
        return t.set_column(t.schema.get_field_index("x"), "x", pa.array(x))

    # No number of partitions: adaptive execution joins small ones, so the upper levels write few files.
    dealt = rows.repartition("node", "source").sortWithinPartitions("node", "source", "__i", "__t")
    return dealt.mapInArrow(reduce, _STATE)


def _same(*names: str) -> Column:
    return reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])


def _apart(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"_{n}" for n in names})


def drawn(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
          seed: int = 1) -> DataFrame:
    """source, `__i`, `__t`, size and `__m`, a number per row, with source_size, target and copies."""
    spark = rows.sparkSession
    key = ("source", "__i", "__t")
    plan = c.staged(targets(c.staged(sources(rows, weights), "weighed"), share, most).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ).withColumn("whole", F.floor("rate")).drop("weight"), "targets")
    # Equal rows are counted by where they lie, so that no task numbers all of a large group.
    lot = F.pmod(F.shiftright("__m", 33), F.lit(c.width(spark)))
    cells = rows.groupBy(*key, "size", lot.alias("lot")).agg(F.count("*").alias("n"))
    equal = Window.partitionBy(*key)
    cells = cells.withColumns({"before": F.sum("n").over(equal.orderBy("lot")) - F.col("n"),
                               "equal": F.sum("n").over(equal)})
    cells = c.staged(cells.join(_apart(plan, "source"), _same("source")).drop("_source").withColumn(
        "share", F.col("equal") * (F.col("rate") - F.col("whole"))).withColumn("sure", F.floor("share")), "cells")
    open_ = cells.filter("before = 0 and share > sure")
    leaves = max(1, -(-open_.count() // LEAF))
    state = open_.select("source", "__i", "__t", "size", (F.col("share") - F.col("sure")).alias("x"),
                         F.pmod(F.xxhash64("__i", "__t"), F.lit(leaves)).alias("node"))
    settled: list[DataFrame] = []
    level = 0
    while True:
        last = leaves == 1
        step = c.staged(_round(state, seed, level, last), "rounded")
        settled.append(step.filter("x = 1").select("source", "__i", "__t", F.lit(1).alias("one")))
        if last:
            break
        leaves = -(-leaves // FAN)
        level += 1
        state = step.filter("x > 0 and x < 1").withColumn(
            "node", F.call_function("div", F.col("node"), F.lit(FAN)))
    up = _apart(reduce(DataFrame.unionByName, settled), *key)
    cells = cells.join(up, _same(*key), "left").select(
        *key, "lot", "before", "source_size", "target", "whole", (F.col("sure") + F.coalesce("one", F.lit(0)))
        .alias("more"))
    place = F.row_number().over(Window.partitionBy(*key, "lot").orderBy("__m"))
    numbered = rows.withColumn("lot", lot).withColumn("place", place)
    out = numbered.join(_apart(cells, *key, "lot"), _same(*key, "lot"))
    return out.select("source", "__i", "__t", "size", "__m", "source_size", "target", (
        F.col("whole") + (F.col("before") + F.col("place") <= F.col("more")).cast("int")).cast("int").alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 1
        ) -> DataFrame:
    """doc_id, keys `__i`, `__t`, source, size, source_size, target and copies, a row per row of docs."""
    keyed = docs.withColumns(c.key_columns(doc_id, text)).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), "__i", "__t", F.col(source).alias("source"),
        _size(text).alias("size"), F.monotonically_increasing_id().alias("__m"))
    sized = c.staged(keyed, "sizes")
    out = drawn(sized.drop("doc_id"), weights, share, most, seed)
    doc = F.when(~c.late(), F.col("__i"))
    return out.select(doc.alias("doc_id"), "__i", "__t", "source", "size", "source_size", "target", "copies")


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(c.WORD_RUN)), F.lit(0)).cast("bigint")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 1
          ) -> DataFrame:
    """The documents, each as often as the mix takes it. Columns stay, whatever their names."""
    plain, (i, x, s) = c.by_position(docs, doc_id, text, source)
    keyed = c.staged(plain.withColumns(c.key_columns(i, x) | {
        "__size": _size(x), "__m": F.monotonically_increasing_id()}), "keyed")
    rows = keyed.select(F.col(s).alias("source"), "__i", "__t", F.col("__size").alias("size"), "__m")
    copies = drawn(rows, weights, share, most, seed).filter("copies > 0").select("__m", "copies")
    taken = keyed.join(c.staged(copies, "copies"), "__m")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *plain.columns).toDF(*docs.columns)
