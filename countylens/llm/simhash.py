"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint has 64 bits: a bit is 1 where more than half of the XXH64 values (seed 42) of its
word shingles have it, repeats counted. Fingerprints link at `RADIUS` = 2 or fewer differing bits.

Every distinct fingerprint is sent out under all variants within half the radius: itself and its 64
neighbours at one bit. Two fingerprints at most 2 bits apart have a variant in common, the one half way,
and meet there. Under one variant there are at most 65 different fingerprints, whatever the data, and
any two of them are at most 2 bits apart; each is linked with the one before it in order, which joins
them all, so no group is ever paired off. The colliding pairs are made distinct, since a pair meets
under several variants, and verified by counting bits. A class is a connected component of the pairs.

Nulls and empty or short texts: with fewer words than a shingle has, the whole sequence is one shingle;
without a word, or for a null text, the fingerprint is 0, linked like any other. A null id never names a
class unless the class has none but null ids; then component_id is null. Repeated rows come out as often
as they came in, with equal results. Ties (a bit set in exactly half of the values) give 0. An empty
table gives an empty one. Other columns are not read, so that their names cannot clash.

Memory: a text is hashed whole, in pieces of 4,096 shingles; a row of the shuffle holds two numbers. Rows
are summed up to distinct fingerprints before they are multiplied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from countylens.llm import common as c
from countylens.llm.components import components

BITS, RADIUS, SEED, PIECE = 64, 2, 42, 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every run of neighbouring words joined by a space; of the whole sequence if it is shorter."""
    found = text.encode().translate(_LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    width = min(words, len(found))
    edges = np.cumsum([0, *map(len, found)]) + np.arange(len(found) + 1)
    starts, ends = edges[:len(found) - width + 1].tolist(), (edges[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = np.ascontiguousarray(hashes[at:at + PIECE]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a bigint."""
    def rows(parts):
        for part in parts:
            found = [fingerprint(shingle_hashes(t, words)) for t in part.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": part.column(0), "fp": pa.array(found, pa.int64())})

    plain, (i, x) = c.by_position(docs, doc_id, text)
    return plain.select(F.col(i).cast("bigint").alias("doc_id"), F.col(x).alias("text")).mapInArrow(
        rows, "doc_id bigint, fp bigint")


def variants(fp: str) -> Column:
    """The fingerprint and its neighbours within half the radius."""
    return F.concat(F.array(F.col(fp)), F.array(*[
        F.col(fp).bitwiseXOR(F.lit(1 << b if b < BITS - 1 else -(1 << b)).cast("bigint"))
        for b in range(BITS)]))


def pairs(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp, enough to join all within the radius."""
    sent = nodes.select("fp", F.explode(variants("fp")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = sent.select(before.alias("a"), F.col("fp").alias("b")).filter("a is not null").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and kept, a row per row of docs.

    kept: whether the row bears its class's id, so that one document of each class stays.
    """
    signed = c.staged(fingerprints(docs, doc_id, text, words), "simhash")
    nodes = c.staged(signed.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    links = c.staged(pairs(nodes), "simhash-pairs")
    placed = nodes.join(components(links), nodes.fp == F.col("node"), "left").select(
        "fp", "low", F.coalesce("comp", "fp").alias("comp"))
    classes = c.staged(placed, "simhash-placed")
    least = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_node = c.staged(classes.join(least, "comp").select("fp", "component_id"), "simhash-classes")
    return signed.join(of_node, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
