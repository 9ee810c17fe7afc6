"""Helpers the operators share: written tables, words, hashes.

Words are runs of bytes other than space and 0x09-0x0D, which is what `bytes.split()` cuts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from countylens.session import shared_dir

WORD_RUN = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows written once to the folder that all executors share, and read from there.

    A lost executor then costs a reread, never a new run of what led here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Partitions of an explicit deal, as many as shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(columns: dict[str, pa.DataType], rows: Iterable[tuple], size: int = 2000
            ) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    schema = pa.schema(list(columns.items()))
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows), schema.types)], schema=schema)


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + mix(np.array([seed + 1], np.uint64)))


_OF_BYTE = numbers(1, 256)
_OF_PLACE = [numbers(2, 256) | np.uint64(1)]
_OF_WORD = numbers(3, 64) | np.uint64(1)


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word, from the word's bytes and their places in it."""
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = _LOWER[raw]
    solid = ~_IS_SPACE[raw]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    longest = int(length.max())
    if longest > len(_OF_PLACE[0]):
        _OF_PLACE[0] = numbers(2, 2 * longest) | np.uint64(1)
    terms = _OF_BYTE[raw[at]] * _OF_PLACE[0][place]
    return mix(np.add.reduceat(terms, first) + length.astype(np.uint64))


def pieces(texts: pa.BinaryArray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, behind) with at most so many bytes of text; a longer text is a run of its own."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    first = 0
    while first < len(texts):
        behind = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, min(behind, len(texts))
        first = behind


def hashed(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of some texts in one array, as `word_hashes` has them, and where each text ends in it.

    Null counts as empty. Texts are hashed together, since most are short.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    solid = ~_IS_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    begins[heads] = solid[heads]
    first_byte = np.flatnonzero(begins)
    if not len(first_byte):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, first_byte)
    length = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, length)
    longest = int(length.max())
    if longest > len(_OF_PLACE[0]):
        _OF_PLACE[0] = numbers(2, 2 * longest) | np.uint64(1)
    terms = _OF_BYTE[raw[at]] * _OF_PLACE[0][place]
    found = mix(np.add.reduceat(terms, first) + length.astype(np.uint64))
    return found, np.searchsorted(first_byte, ends[1:])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _OF_WORD[0]
    for j in range(1, k):
        total = total + hashes[j:j + n] * _OF_WORD[j]
    return mix(total)


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def most_frequent(counts: DataFrame, most: int, group: str) -> DataFrame:
    """Per group the rows of highest `n`, at most `most`, whatever the counts and the size of the table.

    Counts are ranked in steps of a 64th of a doubling; the rows of a step are all in or all out, and no
    row is sorted. One row per group and step, under 4,096 steps, reaches the driver.
    """
    step = F.floor(64 * F.log2("n"))
    spread = counts.groupBy(group, step.alias("step")).agg(F.count("*").alias("rows")).toPandas()
    least = []
    for name, steps in spread.groupby(group):
        steps = steps.sort_values("step", ascending=False)
        fits = steps[steps.rows.cumsum() <= most]
        if len(fits):
            least.append((name, int(fits.step.min())))
    floors = counts.sparkSession.createDataFrame(
        least, T.StructType([counts.schema[group], T.StructField("least", T.LongType())]))
    return counts.join(F.broadcast(floors), group).filter(step >= F.col("least")).drop("least")


def key_columns(doc_id: str, text: str) -> dict[str, Column]:
    """What tells rows apart: the id and 63 bits of the text's MD5; where the id is null, 127 bits of it.

    The last bit of `__t` says whether the id is null. Rows with equal id and equal text have equal keys
    and count as one document.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def half(start: int) -> Column:  # never null, and Spark is to know it: a join then filters nothing
        return F.coalesce(F.conv(F.substring(digest, start, 16), 16, -10).cast("bigint"), F.lit(0))

    marked = half(17).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(doc_id).isNull().cast("bigint"))
    return {"__i": F.coalesce(F.col(doc_id).cast("bigint"), half(1)), "__t": marked}


def late(tag: str = "__t") -> Column:
    """Whether the row of a key has a null id; such rows come last in every order."""
    return F.col(tag).bitwiseAND(F.lit(1)) == 1


def by_position(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows under column names that clash with nothing, and what the given columns are now called.

    `toDF(*docs.columns)` gives the names back.
    """
    now = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*now), [now[docs.columns.index(n)] for n in names]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows per Arrow batch than Spark's own limit, as texts can be long; a lower one stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))
