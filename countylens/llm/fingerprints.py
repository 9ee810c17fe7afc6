"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A fingerprint holds every hash of the text's 16-byte shingles below 1/SCALE of the hash range, so two
fingerprints can be compared, and united, whatever the sizes of their texts: below the threshold both
are complete samples. A text with fewer than FLOOR such hashes keeps its FLOOR lowest; comparisons then
look only below the lower of the two limits up to which both are complete. A shorter text than a shingle is one
shingle; an empty or null text has an empty fingerprint, which is like another empty one (1.0) and
unlike all else (0.0).

The string form is `limit:hashes`, hexadecimal, hashes in ascending order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from countylens.llm import common as c

SCALE, FLOOR, SHINGLE, BITS = 32, 32, 16, 40
TOP = 1 << BITS


def hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles, in BITS bits."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    if len(raw) < SHINGLE:
        raw = np.concatenate([raw, np.full(SHINGLE - len(raw), 256, np.uint64)])
    factor = c.numbers(21, 1) | np.uint64(1)
    total, span = c.mix(raw + np.uint64(7)), 1
    while span < SHINGLE:  # doubles what each hash spans
        total = total[:len(total) - span] * factor + total[span:]
        factor, span = factor * factor, 2 * span
    return c.mix(total) >> np.uint64(64 - BITS)


def sketch(text: str | None, scale: int = SCALE, floor: int = FLOOR) -> tuple[int, np.ndarray]:
    """The limit below which the sketch is complete, and its hashes."""
    every = hashes(text)
    low = np.unique(every[every < TOP // scale])
    if len(low) >= floor:
        return TOP // scale, low
    every = np.unique(every)
    if len(every) <= floor:
        return TOP, every
    return int(every[floor - 1]) + 1, every[:floor]


def written(limit: int, low: np.ndarray) -> str:
    """The string form of a sketch."""
    return f"{limit:x}:{_hex(low)}"


def _hex(low: np.ndarray) -> str:
    parts = low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:]
    return np.ascontiguousarray(parts).tobytes().hex()


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    """The sketch that a fingerprint stands for."""
    limit, _, digits = fingerprint.partition(":")
    n = BITS // 8
    raw = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, n)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - n:] = raw
    return int(limit, 16), full.view(">u8").ravel().astype(np.uint64)


def united(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of two texts together."""
    limit = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return limit, both[both < limit]


def shared(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, int, int]:
    """Hashes in common, of a, and of b, where both sketches are complete."""
    limit = min(a[0], b[0])
    x, y = a[1][a[1] < limit], b[1][b[1] < limit]
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of the shingles of both that they have in common."""
    both, x, y = shared(a, b)
    return both / (x + y - both) if x + y else float(len(a[1]) == len(b[1]))


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of the smaller text's shingles that the other has."""
    both, x, y = shared(a, b)
    return both / min(x, y) if min(x, y) else float(len(a[1]) == len(b[1]))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    kinds = {"doc_id": pa.int64(), "fingerprint": pa.string()}

    def rows(parts):
        for part in parts:
            for i, x in zip(*(col.to_pylist() for col in part.columns)):
                yield i, written(*sketch(x))

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(
        lambda parts: c.batches(kinds, rows(parts), 500), "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many from the front of the other."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


_KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(),
          "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(),
          "near_next": pa.float64(), "contained_edited": pa.float64(), "contained_next": pa.float64()}
_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double, "
           "contained_edited double, contained_next double")


def compared(doc_id, text: str, own, following: str, other) -> tuple:
    """One row for a text, its sketch, the next text and the sketch of that."""
    new = edited(text, following)
    changed = sketch(new)
    return (doc_id, len(text), c.sha256(new.encode()), written(*own), written(*changed),
            likeness(own, changed), likeness(own, other), containment(own, changed),
            containment(own, other))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against its edited text and the next document, by descending id.

    Null ids come last, equal ids in order of a hash of the text, then of the text. Documents are dealt by
    ranges of that order and read as a sorted stream; only the last of each range and the text after it
    meet in a second, small step, which reads the same shuffle.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(
        c.width(spark), F.desc_nulls_last("doc_id"), "tie").sortWithinPartitions(
        F.desc_nulls_last("doc_id"), "tie", "text")

    def inner(parts):
        def rows():
            held = None
            for part in parts:
                names, texts = (part.column(n).to_pylist() for n in ("doc_id", "text"))
                for i, x in zip(names, texts):
                    own = sketch(x)
                    if held is not None:
                        yield compared(*held, x, own)
                    held = (i, x, own)

        yield from c.batches(_KINDS, rows(), 200)

    def edges(parts):
        from pyspark import TaskContext

        first = last = None
        for part in parts:
            names, texts = part.column("doc_id"), part.column("text")
            if len(names):
                first = first or (names[0].as_py(), texts[0].as_py())
                last = (names[-1].as_py(), texts[-1].as_py())
        if first:
            yield pa.record_batch({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "doc_id": pa.array([last[0]], pa.int64()), "text": pa.array([last[1]]),
                "head": pa.array([first[1]])})

    # One row per range: in the one task of this window meet as many rows as there are partitions.
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = dealt.mapInArrow(edges, "part int, doc_id bigint, text string, head string").select(
        "doc_id", "text",
        F.coalesce(F.lead("head").over(order), F.first("head").over(whole)).alias("head"))

    def outer(parts):
        def rows():
            for part in parts:
                for i, x, y in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text", "head"))):
                    yield compared(i, x, sketch(x), y, sketch(y))

        yield from c.batches(_KINDS, rows(), 200)

    return dealt.mapInArrow(inner, _SCHEMA).unionByName(borders.mapInArrow(outer, _SCHEMA))
