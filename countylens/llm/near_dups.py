"""MinHash near-dedup with an LSH forest.

A document is its set of distinct word shingles (A-Z lower-cased). Equal sets are one node. Each node
has `TREES` labels of `DEPTH` minhash values. A tree is the nodes sorted by one label; neighbours in
that order are those with the longest common prefix. A node is compared with the nodes before it in
the order that share at least `LEAST` values, nearest first, so that the depth it reaches adapts to
the region: where labels are sparse a short prefix is enough, where they are crowded the nearest
prefixes are longer. A one-bit sketch of 128 hash values sorts out unlikely pairs, by a margin of five
standard deviations; what passes is confirmed on the full sets, exactly.

Dense regions. At first, of a node's passing neighbours the nearest `NEAREST` of `REACH` are taken in each
tree, and the leader (lowest node) of its region. Leaders are confirmed first; neighbours are then
confirmed only where they would join two components, so the work in a group of near copies grows with its
members, not with their square. A region where a node stopped before it had seen all nodes in front
of it is open, and so is one at either end of a range of the order, as it may be cut there. Open regions
that by then are one component are done. In the others all pairs from different components are
compared, on full sets: regions with the same largest component are taken together, their nodes are
dealt into blocks of half a million shingles, and a task takes two blocks. A group of near copies is
then some blocks against the few nodes beside it. Only a family whose members are alike but not linked,
and more than fill a block, is sent out more than once per region: as often as it has blocks.

Recall. Every two nodes of different components that share a prefix of four values in a tree are compared.
Two nodes at the threshold share one in a tree with probability 0.41; that all 24 trees miss them has
probability 3e-6.

Rows with equal id and text count as one document. Null ids never become a component id unless all ids
of a component are null. Texts with no word have an empty set, no link, and their own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from countylens.llm import common as c
from countylens.llm.components import components

TREES, DEPTH, LEAST, REACH, NEAREST = 24, 8, 4, 64, 3
#: Shingles of the sets in a block.
BLOCK = 1 << 19
_HASHES = TREES * DEPTH
_FACTOR = (c.numbers(11, _HASHES) | np.uint64(1))[:, None]
_SHIFT = c.numbers(12, _HASHES)[:, None]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, one with no word has none."""
    h = c.word_hashes(text.encode(), lower=True) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    return np.unique(c.shingles(h, min(words, len(h))))


def node_of(members: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([c.mix(members).sum(dtype=np.uint64),
                     c.mix(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def minima(members: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    low = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 512):
        part = (members[None, at:at + 512] ^ _SHIFT) * _FACTOR
        np.minimum(low, part.min(axis=1), out=low)
    return c.mix(low)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Keys, set size, node, one-bit sketch and tree labels of every row; null node for empty sets."""
    kinds = {"doc_id": pa.int64(), "__i": pa.int64(), "__t": pa.int64(), "n": pa.int32(),
             "node": pa.binary(), "bits": pa.binary(), "labels": pa.binary()}

    def rows(parts):
        for part in parts:
            for d, i, t, x in zip(*(col.to_pylist() for col in part.columns)):
                members = shingle_set(x, words)
                if not len(members):
                    yield d, i, t, 0, None, None, None
                    continue
                low = minima(members)
                bits = np.packbits((low[:128] & np.uint64(1)).astype(bool))
                labels = (low >> np.uint64(48)).astype(">u2")
                yield d, i, t, len(members), node_of(members), bits.tobytes(), labels.tobytes()

    return docs.mapInArrow(
        lambda parts: c.batches(kinds, rows(parts), 500),
        "doc_id bigint, __i bigint, __t bigint, n int, node binary, bits binary, labels binary")


def most_apart(threshold: float) -> int:
    """Bits of the sketch in which linked nodes differ at most, five standard deviations above the mean."""
    agree = (1 + threshold) / 2
    return int(128 * (1 - agree + 5 * np.sqrt(agree * (1 - agree) / 128)))


def neighbours(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, late) of nodes near in a tree; late 0: with the leader of a region, else 1.

    Rows with late 2 name the open regions in `a`. Reads (tree, label, node, n, bits), dealt by ranges of
    the order and sorted, in a stream.
    """
    far = most_apart(threshold)

    def pairs(parts):
        held: list[np.ndarray] | None = None
        cut = False  # whether the open region has rows before the held ones
        for part in parts:
            new = _arrays(part)
            if not len(new[0]):
                continue
            if held is not None:
                new = [np.concatenate([h, x]) for h, x in zip(held, new)]
            kept = 0 if held is None else len(held[0])
            if held is None:
                yield _open(new[0][:1])  # it may have begun in the range before
            yield from _near(new, kept, threshold, far, cut)
            # The leader of the open region goes along in front of the last rows.
            head = new[0]
            start = int(np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))[-1])
            lead = start + int(np.argmin(new[1][start:]))
            tail = np.arange(max(start, len(head) - REACH), len(head))
            cut = start < len(head) - REACH or cut and not start
            keep = np.unique(np.append(tail, lead))
            held = [x[keep] for x in new]
        if held is not None:
            yield _open(held[0][-1:])  # it may go on in the range behind

    def _near(rows_, kept, limit, most, cut):
        head, node, n, low, high = rows_
        at = np.arange(len(head))
        taken = np.zeros(len(head), np.int32)
        seen = np.zeros(len(head), np.int32)  # rows in front that it has looked at
        found_a, found_b, late = [], [], []
        begin = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        order = np.lexsort((node, np.repeat(np.arange(len(begin)),
                                            np.diff(begin, append=len(head)))))
        leader = np.repeat(order[begin], np.diff(begin, append=len(head)))

        def passing(i, j):
            close = np.minimum(n[i], n[j]) >= limit * np.maximum(n[i], n[j])
            apart = np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j])
            return close & (apart <= most)

        i = at[kept:][leader[kept:] != at[kept:]]
        ok = passing(i, leader[i])
        found_a.append(leader[i][ok])
        found_b.append(i[ok])
        late.append(np.zeros(int(ok.sum()), np.int32))
        live = at[max(kept, 1):]
        for j in range(1, REACH + 1):
            live = live[(live >= j) & (taken[live] < NEAREST)]
            live = live[head[live] == head[live - j]]
            if not len(live):
                break
            ok = live[passing(live, live - j)]
            taken[ok] += 1
            found_a.append(ok - j)
            found_b.append(ok)
            late.append(np.ones(len(ok), np.int32))
            seen[live] = j
        before = at - np.repeat(begin, np.diff(begin, append=len(head)))
        open_ = before > seen
        open_[:kept] = False
        if cut:
            open_[kept:] |= head[kept:] == head[0]
        yield _open(head[open_])
        a, b, z = (np.concatenate(x) for x in (found_a, found_b, late))
        names = node.tolist()
        for s in range(0, len(a), 5000):
            x = [names[k] for k in a[s:s + 5000]]
            y = [names[k] for k in b[s:s + 5000]]
            yield pa.record_batch({
                "a": pa.array([min(p) for p in zip(x, y)], pa.binary()),
                "b": pa.array([max(p) for p in zip(x, y)], pa.binary()),
                "late": pa.array(z[s:s + 5000], pa.int32())})

    width = c.width(rows.sparkSession)
    dealt = rows.repartitionByRange(width, "tree", "label", "node").sortWithinPartitions(
        "tree", "label", "node")
    return (dealt.mapInArrow(pairs, "a binary, b binary, late int").filter("a <> b")
            .groupBy("a", "b").agg(F.min("late").alias("late")))


def region(tree, labels) -> Column:
    """The name of a node's region in a tree."""
    return F.concat(F.substring(labels, tree * (2 * DEPTH) + 1, F.lit(2 * LEAST)),
                    F.unhex(F.lpad(F.hex(tree), 2, "0")))


def _open(heads: np.ndarray) -> pa.RecordBatch:
    """Regions, once each, as rows of `neighbours`."""
    names = [x[:2 * LEAST] + x[15:] for x in {h.tobytes() for h in heads}]
    return pa.record_batch({"a": pa.array(names, pa.binary()),
                            "b": pa.array([b""] * len(names), pa.binary()),
                            "late": pa.array([2] * len(names), pa.int32())})


def _arrays(part: pa.RecordBatch) -> list[np.ndarray]:
    """Region prefix, node, set size and the halves of the sketch."""
    tree, label, node, n, bits = part.columns
    label = np.frombuffer(b"".join(label.to_pylist()), np.uint8)
    head = np.zeros((len(tree), 16), np.uint8)
    head[:, :2 * LEAST] = label.reshape(-1, 2 * DEPTH)[:, :2 * LEAST]
    head[:, 15] = np.asarray(tree).astype(np.uint8)
    sketch = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, 2)
    names = np.empty(len(tree), object)
    names[:] = node.to_pylist()
    return [head.view("V16").ravel(), names, np.asarray(n), sketch[:, 0], sketch[:, 1]]


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    percent = round(100 * threshold)

    def check(parts):
        for part in parts:
            a, b, x, y = (part.column(n).to_pylist() for n in ("a", "b", "x", "y"))
            keep = []
            for p, q in zip(x, y):
                keep.append(alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent))
            yield pa.record_batch({"a": pa.array([v for v, k in zip(a, keep) if k], pa.binary()),
                                   "b": pa.array([v for v, k in zip(b, keep) if k], pa.binary())})

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        check, "a binary, b binary")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, members) of the wanted nodes, each from one document that has it."""
    kinds = {"node": pa.binary(), "members": pa.binary()}

    def rows(parts):
        for part in parts:
            for node, x in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                yield node, shingle_set(x, words).tobytes()

    texts = docs.select("__i", "__t", "text").join(wanted, ["__i", "__t"])
    return (texts.select("node", "text")
            .mapInArrow(lambda parts: c.batches(kinds, rows(parts), 200),
                        "node binary, members binary").dropDuplicates(["node"]))


def mixed(signed: DataFrame, open_: DataFrame, comps: DataFrame) -> DataFrame:
    """(top, node, major, minors, majors) of the open regions with more than one component.

    top is the largest component of a region. Regions with the same one are taken together, so a node
    is named once for all of them. major: whether the node is of that component; minors and majors: how
    many blocks the other nodes and those of the component are dealt into, by the size of their sets.
    """
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: region(t, F.col("labels")))
    at = (signed.filter("node is not null").select("node", "n", F.explode(trees).alias("region"))
          .join(open_, "region", "left_semi").distinct())
    at = c.staged(at.join(comps, "node", "left").select(
        "region", "node", "n", F.coalesce("comp", "node").alias("comp")), "open")
    spread = at.groupBy("region", "comp").agg(F.count("*").alias("m"))
    tops = spread.groupBy("region").agg(F.count("*").alias("kinds"), F.max(F.struct("m", "comp")).alias("top"))
    tops = tops.filter("kinds > 1").select("region", F.col("top.comp").alias("top"))
    named = c.staged(at.join(tops, "region").select(
        "top", "node", "n", "comp", (F.col("comp") == F.col("top")).alias("major")).distinct(), "named")
    size = {name: F.ceil(F.sum(F.when(F.col("major") == (name == "majors"), F.col("n"))) / BLOCK).cast("int")
            for name in ("minors", "majors")}
    sizes = named.groupBy("top").agg(*[x.alias(name) for name, x in size.items()])
    return c.staged(named.join(sizes, "top").select("top", "node", "comp", "major", "minors", "majors"), "mixed")


def remaining(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components in what `mixed` gives, enough to join all.

    A task takes two blocks, never two of the largest component. It holds the sets of the first as one sorted list of hashes with
    their owners, looks up each set of the second in it, and so has all its overlaps at once, exactly.
    """
    percent = round(100 * threshold)

    def compared(key, table):
        p, q = key[1].as_py(), key[2].as_py()
        block = table.column("block").to_numpy()
        names, comp = table.column("node").to_pylist(), table.column("comp").to_pylist()
        members = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        n = np.array([len(x) for x in members])
        label = np.unique(np.array(comp, object), return_inverse=True)[1]
        first, second = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if not len(first) or not len(second):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        held = np.concatenate([members[i] for i in first])
        order = np.argsort(held, kind="stable")
        owner = np.repeat(np.arange(len(first)), n[first])[order]
        values, start = np.unique(held[order], return_index=True)
        size = np.diff(start, append=len(held))
        a, b = [], []
        for j in second:
            place = np.minimum(np.searchsorted(values, members[j]), len(values) - 1)
            place = place[values[place] == members[j]]
            many = size[place]
            rows_ = np.repeat(start[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(owner[rows_], minlength=len(first))
            for i in first[100 * both >= percent * (n[first] + n[j] - both)]:
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    a.append(min(names[i], names[j]))
                    b.append(max(names[i], names[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    block = F.when(F.col("major"), F.col("minors") + F.pmod(F.xxhash64("node"), "majors")).otherwise(
        F.pmod(F.xxhash64("node"), "minors"))
    last = F.when(F.col("major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    dealt = rows.join(sets, "node").select(
        "top", "node", "comp", "members", block.cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return (dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
            .groupBy("top", "p", "q").applyInArrow(compared, "a binary, b binary").distinct())


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) once further links (a, b) are added."""
    if links.isEmpty():
        return comps
    side = comps.select(F.col("node").alias("a"), F.col("comp").alias("p"))
    other = comps.select(F.col("node").alias("b"), F.col("comp").alias("q"))
    tops = components(links.join(side, "a", "left").join(other, "b", "left").select(
        F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")))
    tops = tops.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    inside = comps.join(tops, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    alone = tops.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti").select(
        F.col("comp").alias("node"), F.col("top").alias("comp"))
    return c.staged(inside.unionByName(alone), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                    threshold: float = 0.8) -> DataFrame:
    """doc_id, keys `__i`, `__t`, n_shingles, component_id, stays and kept, a row per row of docs.

    kept: whether the row bears its component's id; stays: whether it has the lowest key of the component.
    """
    keyed = docs.withColumns(c.key_columns(doc_id, text)).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), "__i", "__t", F.col(text).alias("text"))
    signed = c.staged(signatures(keyed, words), "signatures")
    nodes = signed.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(c.late().alias("late"), "__i", "__t")).alias("low"),
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("labels").alias("labels"))
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.alias("tree"), F.substring("labels", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("label")))
    rows = nodes.select("node", "n", "bits", F.explode(trees).alias("at")).select(
        "at.tree", "at.label", "node", "n", "bits")
    pairs = c.staged(neighbours(rows, threshold), "pairs")

    ends = pairs.filter("late < 2").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    lows = signed.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(c.late().alias("late"), "__i", "__t")).alias("low"))
    lows = c.staged(lows.select("node", "low.late", "low.__i", "low.__t"), "lows")
    wanted = lows.join(ends, "node", "left_semi").select("node", "__i", "__t")
    sets = c.staged(full_sets(keyed, wanted, words), "sets")

    first = c.staged(confirmed(pairs.filter("late = 0").select("a", "b"), sets, threshold), "links")
    comps = components(first)
    side = comps.select(F.col("node").alias("a"), F.col("comp").alias("p"))
    other = comps.select(F.col("node").alias("b"), F.col("comp").alias("q"))
    open_ = (pairs.filter("late = 1").join(side, "a", "left").join(other, "b", "left")
             .filter(~F.coalesce("p", "a").eqNullSafe(F.coalesce("q", "b"))).select("a", "b"))
    more = c.staged(confirmed(open_, sets, threshold), "links")
    comps = joined(comps, more)

    open_ = c.staged(pairs.filter("late = 2").select(F.col("a").alias("region")), "regions")
    rest = mixed(signed, open_, comps)
    if not rest.isEmpty():
        names = c.staged(rest.select("node").distinct(), "names")
        lacking = lows.join(names, "node", "left_semi").join(
            sets.select("node"), "node", "left_anti").select("node", "__i", "__t")
        sets = sets.unionByName(c.staged(full_sets(keyed, lacking, words), "sets"))
        comps = joined(comps, c.staged(remaining(rest, sets, threshold), "links"))

    # The lowest key of a component names it and says which of its rows stays.
    placed = c.staged(lows.join(comps, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"), F.struct("late", "__i", "__t").alias("low")), "placed")
    least = c.staged(placed.groupBy("comp").agg(F.min("low").alias("least")), "least")
    of_node = c.staged(placed.join(least, "comp").select(
        "node", F.when(~F.col("least.late"), F.col("least.__i")).alias("component_id"),
        F.col("least.__i").alias("__li"), F.col("least.__t").alias("__lt")), "of_node")
    out = signed.select("doc_id", "__i", "__t", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "__i", "__t", F.col("n").cast("bigint").alias("n_shingles"),
                      component.alias("component_id"),
                      ((F.col("__i") == F.col("__li")) & (F.col("__t") == F.col("__lt"))).alias("stays")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
          threshold: float = 0.8) -> DataFrame:
    """The documents, one row of each component: of the smallest id, null last; of equal ids the one whose
    text has the lowest hash; of equal rows any one. Texts with no word all stay. Columns stay, whatever
    their names.
    """
    plain, (i, x) = c.by_position(docs, doc_id, text)
    found = near_duplicates(plain, i, x, words, threshold).select("__i", "__t", "stays", "n_shingles")
    rows = c.staged(found.groupBy("__i", "__t").agg(
        F.count("*").alias("rows"), F.first("stays").alias("stays"), F.max("n_shingles").alias("n")), "keys")
    gone = rows.filter("n > 0 and not stays").select("__i", "__t")
    many = rows.filter("n > 0 and stays and rows > 1").select("__i", "__t")
    keyed = plain.withColumns(c.key_columns(i, x))
    if many.isEmpty():
        kept = keyed.join(gone, ["__i", "__t"], "left_anti")
    else:
        kept = keyed.join(gone.unionByName(many), ["__i", "__t"], "left_anti").unionByName(
            keyed.join(many, ["__i", "__t"], "left_semi").dropDuplicates(["__i", "__t"]))
    return kept.select(*plain.columns).toDF(*docs.columns)
