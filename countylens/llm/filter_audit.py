"""Filter interaction audit with sorted posting lists.

Filters are applied one after another, in every order. For each part of the corpus (a language) and each
filter the audit keeps the sorted list of the ids that fail it, cut into ranges of ids. What a set of
filters removes is the union of their lists, what a filter removes after them is its list less that
union; both come from merges that gallop: the longer list is skipped in doubling steps to where the next
ids of the shorter one can lie. Sizes of the differences, and of their meets with the lists of good and
of toxic ids, are summed over ranges. They depend on the set of filters before, not on its order, so 80
sums a part give all 120 orders with 5 steps each.

Spark deals the ids in ranges of (part, id); a task reads its range in order and holds the lists of at
most `CHUNK` rows at a time, so one language may hold nearly all rows. Inside a range, ids are numbered
in order, which keeps rows with equal or null ids apart.

Filters, on the text (null: empty) and its words `[^\\x20\\x09-\\x0D]+`: A under 200 words; B distinct words
under half of the words; C more than 3 % of the code points in A-Z; D any of `#$%&*|`; E equal to the text
of any smaller id in the table. An empty text fails A only, and E where an empty text has a smaller id.
Null ids are not compared: such a row never fails E and makes none fail. Repeated rows (equal id) count
each, and do not make each other fail E. A null language is the part ''. A label counts once for an id,
however often it is given; labels of null ids count for nothing. An empty table has no part and gives no
row. Long texts are read whole, one at a time. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from countylens.llm import common as c

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
CHUNK, STRIDE = 1 << 16, 64
_CAPITALS = bytes(range(65, 91))
_MARKS = re.compile(r"[#$%&*|]")


def failures(text: str) -> int:
    """The filters A to D that a text fails, as bits."""
    data = text.encode()
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * capitals > 3 * len(text)) << 2 | (_MARKS.search(text) is not None) << 3)


def flagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(part, id, tie, failed) of every row: failed as bits of the filters A to E, tie its own in the table."""
    def rows(parts):
        for part in parts:
            texts = [t or "" for t in part.column(2).to_pylist()]
            yield pa.record_batch({
                "part": part.column(0), "id": part.column(1),
                "failed": pa.array([failures(t) for t in texts], pa.int32()),
                "hash": pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts],
                                 pa.binary())})

    plain, (i, x, l) = c.by_position(docs, doc_id, text, lang)
    read = plain.select(
        F.coalesce(F.col(l), F.lit("")).alias("part"), F.col(i).cast("bigint").alias("id"),
        F.col(x).alias("text")).mapInArrow(rows, "part string, id bigint, failed int, hash binary")
    read = c.staged(read.withColumn("tie", F.monotonically_increasing_id()), "failed")
    # Joined by id and text, not by text alone: a text that a third of the rows share is dealt evenly.
    firsts = read.filter("id is not null").groupBy("hash").agg(F.min("id").alias("id")).withColumn(
        "first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    return read.join(firsts, ["id", "hash"], "left").select(
        "part", "id", "tie", (F.col("failed") + F.when(again, 16).otherwise(0)).alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good and toxic: whether their id is labelled so at least once."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(marks, "id", "left").select(
        "part", "id", "tie", "failed", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))


def found(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which ids of a sorted list are in another sorted list.

    For each stride of the first, doubling steps find where in the second the stride's last id would lie;
    only up to there it is searched, and the next stride goes on from there.
    """
    out = np.zeros(len(short), bool)
    low = 0
    for at in range(0, len(short), STRIDE):
        if low == len(long):
            break
        wanted = short[at:at + STRIDE]
        step, high = STRIDE, low
        while high < len(long) and long[high] < wanted[-1]:
            high += step
            step *= 2
        reach = long[low:high + 1]
        place = np.searchsorted(reach, wanted)
        inside = place < len(reach)
        out[at:at + STRIDE][inside] = reach[place[inside]] == wanted[inside]
        low += int(place[-1])
    return out


def less(ids: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The ids of a sorted list that are not in another one."""
    if len(ids) <= len(gone):
        return ids[~found(ids, gone)]
    kept = np.ones(len(ids), bool)
    both = gone[found(gone, ids)]
    kept[np.searchsorted(ids, both)] = False
    return ids[kept]


def meet(one: np.ndarray, other: np.ndarray) -> int:
    """How many ids two sorted lists share."""
    short, long = sorted((one, other), key=len)
    return int(found(short, long).sum())


def union(lists: list[np.ndarray]) -> np.ndarray:
    """The ids in any of the sorted lists, merged from the longest on; only new ids are put in."""
    if not lists:
        return np.zeros(0, np.int64)
    first, *rest = sorted(lists, key=len, reverse=True)
    for ids in rest:
        new = ids[~found(ids, first)]
        first = np.insert(first, np.searchsorted(first, new), new)
    return first


def sums(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Per filter and set of filters before it: ids removed, good and toxic ones among them."""
    out = np.zeros((len(lists), ALL + 1, 3), np.int64)
    for before in range(ALL + 1):
        gone = union([ids for k, ids in enumerate(lists) if before >> k & 1])
        for k, ids in enumerate(lists):
            if not before >> k & 1:
                left = less(ids, gone)
                out[k, before] = len(left), meet(left, good), meet(left, toxic)
    return out


def posting_sums(rows: DataFrame) -> DataFrame:
    """(part, filter, before, docs, removed, good, toxic) summed over the ranges of ids.

    filter is a place in `FILTERS`, before the bits of the filters applied before it.
    """
    def audit(parts):
        name, held, total, docs = None, [], None, 0

        def close():
            nonlocal held, total
            if held:
                failed, good, toxic = (np.concatenate(x) for x in zip(*held))
                lists = [np.flatnonzero(failed >> k & 1) for k in range(len(FILTERS))]
                total = total + sums(lists, np.flatnonzero(good), np.flatnonzero(toxic))
                held = []

        def told():
            for k, before in itertools.product(range(len(FILTERS)), range(ALL + 1)):
                if not before >> k & 1:
                    yield (name, k, before, docs, *total[k, before].tolist())

        for part in parts:
            parts_, failed, good, toxic = (x.to_numpy(zero_copy_only=False) for x in part.columns)
            if not len(parts_):
                continue
            edges = np.flatnonzero(np.append(True, parts_[1:] != parts_[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(parts_))):
                if name != parts_[a] or total is None:
                    close()
                    if total is not None:
                        yield from told()
                    name, total, docs = parts_[a], np.zeros((len(FILTERS), ALL + 1, 3), np.int64), 0
                held.append((failed[a:b], good[a:b], toxic[a:b]))
                docs += int(b - a)
                if sum(len(x[0]) for x in held) >= CHUNK:
                    close()
        close()
        if total is not None:
            yield from told()

    kinds = {"part": pa.string(), "filter": pa.int32(), "before": pa.int32(), "docs": pa.int64(),
             "removed": pa.int64(), "good": pa.int64(), "toxic": pa.int64()}
    # A range can end between rows of equal or null id, by their tie.
    dealt = rows.repartitionByRange(
        c.width(rows.sparkSession), "part", "id", "tie").sortWithinPartitions("part", "id", "tie")
    return dealt.select("part", "failed", "good", "toxic").mapInArrow(
        lambda parts: c.batches(kinds, audit(parts)),
        "part string, filter int, before int, docs bigint, removed bigint, good bigint, toxic bigint"
    ).groupBy("part", "filter", "before").agg(*[F.sum(n).alias(n) for n in kinds if kinds[n] == pa.int64()])


def orders(spark) -> DataFrame:
    """The 600 steps of all orders: filter_order, step, filter, and the set of filters before it."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order):
            rows.append((name, step + 1, k, before))
            before |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> DataFrame:
    """A row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sums_ = c.staged(posting_sums(labelled(flagged(docs, doc_id, text, lang), labels)), "postings")
    ways = F.element_at(F.array(*[F.lit(math.factorial(n) * math.factorial(len(FILTERS) - 1 - n))
                                  for n in range(len(FILTERS))]), F.bit_count("before") + 1)
    per_filter = sums_.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.bit_count("before") == len(FILTERS) - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(ways * F.col("removed")).alias("shapley"))
    steps = sums_.join(F.broadcast(orders(docs.sparkSession)), ["filter", "before"]).join(
        per_filter, ["part", "filter"])
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return steps.select(
        "part", "filter_order", "step", (F.col("docs") - gone).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
