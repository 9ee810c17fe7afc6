"""Source divergence audit: which terms mark a source within its language, by dominance skybands.

Terms are runs of letters (A-Z lower-cased) and of code points from 0x80 on. A language keeps the V terms
that at least `LEAST` of its documents hold. A group is a (language, source); for a group or a language
with n occurrences of a kept term and N of all, p = 1 + floor(10^9 (n + 5) / (N + 5 V)), in whole numbers.

Terms of a group are ranked by p - q, p the group's and q the language's share. That grows with the count
in the group and falls with the count in the language, and the earlier term in UTF-8 wins a tie. So a
term that `TOP` others surpass or equal in both counts while they come earlier is not among the first
`TOP`. A task keeps of its terms the skyband, those that fewer than `TOP` others dominate; skybands are
merged over salted parts of a group and then over whole groups, and only what is left, some thousand
terms a group, is ranked by exact values. A dominated term has its `TOP` dominators in the skyband too,
so a skyband of skybands is that of the whole.

Pairs of sources are summed over all kept terms: per term the counts of up to `WIDE` sources against up to
`WIDE` others, the terms dealt in salted shares of some `TERMS`; terms that none of these sources holds are
accounted for by their number. Nothing is as large as the square of a group, but the result itself, a
row per pair of sources of a language.

Null text, language or source is an empty string. A group without terms still has its pairs, with the
shares that zero counts give; where a language keeps no term all pairs are 0 and no term is named. Empty
table: no rows. Repeated rows count each. Long texts are cut whole, one at a time; a task counts terms in
a table of at most `HELD` entries beyond those of its last document, then hands them on. Ties are ranked
by UTF-8 bytes. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from countylens.llm import common as c

LEAST, TOP, ONE, EXTRA = 30, 50, 10 ** 9, 5
HELD, BATCH, WIDE, TERMS = 1 << 18, 1 << 14, 256, 4096
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP = ["lang", "source"]


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group.

    Each group has a row of the empty term as well, which counts its documents.
    """
    def told(held):
        for (lang, source), (n, docs_) in held.items():
            yield from ((lang, source, t, k, docs_[t]) for t, k in n.items())

    def rows(parts):
        held, size = {}, 0
        for part in parts:
            for text, lang, source in zip(*(x.to_pylist() for x in part.columns)):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                found = Counter(terms(text))
                n.update(found)
                docs_.update(found.keys())
                n[b""] += 0
                docs_[b""] += 1
                size += len(n)
                if size > HELD:
                    yield from told(held)
                    held, size = {}, 0
        yield from told(held)

    kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "n": pa.int64(), "docs": pa.int64()}
    plain = docs.select(*[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("text", *GROUP)])
    return plain.mapInArrow(
        lambda parts: c.batches(kinds, rows(parts), BATCH),
        "lang string, source string, term binary, n bigint, docs bigint").groupBy(*GROUP, "term").agg(
            F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """p of a count, in whole numbers of up to 31 digits, so that no count overflows."""
    n, total, kept = (f"cast({x} as decimal(20,0))" for x in (n, total, kept))
    return F.expr(f"1 + ({ONE} * ({n} + {EXTRA})) div nullif({total} + {EXTRA} * {kept}, 0)").cast("bigint")


def skyband(group: np.ndarray, lang: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms that fewer than k others dominate: group count no lower, count in the
    language no higher, earlier in UTF-8."""
    rank = np.empty(len(term), np.int64)
    rank[np.argsort(term, kind="stable")] = np.arange(len(term))
    # Those that dominate a term come before it in this order; of them, kept ones suffice.
    order = np.lexsort((rank, lang, -group))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), 256):
        new = order[at:at + 256]
        above = np.count_nonzero((lang[kept, None] <= lang[new]) & (rank[kept, None] < rank[new]), axis=0)
        new, above = new[above < k], above[above < k]
        more: list[int] = []
        for i, n in zip(new, above):
            beside = np.array(more, np.int64)
            if n + np.count_nonzero((lang[beside] <= lang[i]) & (rank[beside] < rank[i])) < k:
                more.append(i)
        kept = np.append(kept, np.array(more, np.int64))
    return kept


def skybands(cells: DataFrame, k: int) -> DataFrame:
    """Of (lang, source, term, n, in_lang), the rows in the skyband of their group within this partition."""
    def reduced(held):
        group, lang = (np.concatenate([x[j] for x in held]) for j in (1, 2))
        term = np.concatenate([x[0] for x in held])
        keep = skyband(group, lang, term, k)
        return term[keep], group[keep], lang[keep]

    def told(bands):
        for (lang, source), held in bands.items():
            term, n, in_lang = reduced(held)
            for at in range(0, len(term), BATCH):
                end = at + BATCH
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(term[at:end]), pa.string()),
                    "source": pa.array([source] * len(term[at:end]), pa.string()),
                    "term": pa.array(term[at:end].tolist(), pa.binary()),
                    "n": pa.array(n[at:end], pa.int64()), "in_lang": pa.array(in_lang[at:end], pa.int64())})

    def rows(parts):
        bands, sizes, total = {}, {}, 0
        for part in parts:
            if not part.num_rows:
                continue
            table = pa.Table.from_batches([part]).sort_by([(x, "ascending") for x in GROUP])
            lang, source, term = (np.array(table.column(x).to_pylist(), object) for x in (*GROUP, "term"))
            n, in_lang = (table.column(x).to_numpy() for x in ("n", "in_lang"))
            edges = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (source[1:] != source[:-1])))
            for a, b in zip(edges, np.append(edges[1:], len(lang))):
                key = lang[a], source[a]
                held = bands.setdefault(key, [])
                held.append((term[a:b], n[a:b], in_lang[a:b]))
                size = sizes.get(key, 0) + int(b - a)
                total += int(b - a)
                if size > BATCH:  # at least half of it is new
                    band = reduced(held)
                    bands[key] = [band]
                    total -= size - len(band[0])
                    size = min(len(band[0]), BATCH // 2)
                sizes[key] = size
            if total > 2 * HELD:
                yield from told(bands)
                bands, sizes, total = {}, {}, 0
        yield from told(bands)

    return cells.select(*GROUP, "term", "n", "in_lang").mapInArrow(
        rows, "lang string, source string, term binary, n bigint, in_lang bigint")


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value, seen): |p - q| of two sources summed over the `seen` terms that were compared.

    Reads cells (lang, term, i, p) and groups (lang, kept, sources, i, zero), i the source's number in
    its language and zero its share for no occurrence.
    """
    kinds = {"lang": pa.string(), "i": pa.int32(), "j": pa.int32(), "value": pa.int64(), "seen": pa.int64()}

    def compared(key, table):
        lang, p, q = (x.as_py() for x in key[:3])
        i, value = table.column("i").to_numpy(), table.column("p").to_numpy()
        code = table.column("term").combine_chunks().dictionary_encode()
        zero_at = code.dictionary.to_pylist().index(b"")
        code = code.indices.to_numpy()
        zeros = code == zero_at
        ids, start = i[zeros], value[zeros]
        order = np.argsort(ids)
        ids, start = ids[order], start[order]
        grid = np.repeat(start[None, :], int(code.max()) + 1, axis=0)
        grid[code, np.searchsorted(ids, i)] = value
        grid = np.delete(grid, zero_at, axis=0)
        left, right = np.flatnonzero(ids // WIDE == p), np.flatnonzero(ids // WIDE == q)
        total = np.zeros((len(left), len(right)), np.int64)
        step = max(1, (1 << 20) // max(1, total.size))
        for at in range(0, len(grid), step):
            part = grid[at:at + step]
            total += np.abs(part[:, left, None] - part[:, None, right]).sum(axis=0)
        out = [(a, b, total) for a, b in ((left, right),)] + (
            [(right, left, total.T)] if p != q else [])
        made = [pa.table({
            "lang": pa.array([lang] * t.size, pa.string()), "i": pa.array(np.repeat(ids[a], len(b)), pa.int32()),
            "j": pa.array(np.tile(ids[b], len(a)), pa.int32()), "value": pa.array(t.ravel(), pa.int64()),
            "seen": pa.array(np.full(t.size, len(grid)), pa.int64())}) for a, b, t in out]
        return pa.concat_tables(made)

    block = F.floor(F.col("i") / WIDE).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / WIDE).cast("int")))
    shares = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")
    at = F.pmod(F.xxhash64("term"), shares).cast("int")
    sizes = groups.select("lang", "i", "kept", "sources")
    real = cells.join(sizes, ["lang", "i"]).select("lang", "i", "sources", "term", "p", at.alias("salt"))
    none = groups.select("lang", "i", "sources", F.lit(b"").alias("term"), F.col("zero").alias("p"),
                         F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"))
    dealt = real.unionByName(none).select("*", block.alias("own"), others.alias("other")).select(
        "lang", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "salt",
        "term", "i", "p")
    found = dealt.groupBy("lang", "left", "right", "salt").applyInArrow(
        compared, "lang string, i int, j int, value bigint, seen bigint")
    return found.groupBy("lang", "i", "j").agg(*[F.sum(x).alias(x) for x in list(kinds)[3:]])


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: parts `pair` and `term` of every group."""
    counts = c.staged(term_counts(docs), "terms")
    by_lang = counts.filter("term <> x''").groupBy("lang", "term").agg(
        F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    by_lang = c.staged(by_lang, "kept-terms")
    langs = by_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("in_lang_all"))
    cells = c.staged(counts.join(by_lang, ["lang", "term"]).select(*GROUP, "term", "n", "in_lang"), "cells")
    sums = cells.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.filter("term = x''").select(*GROUP).join(sums, GROUP, "left").join(langs, "lang", "left")
    groups = groups.select(
        *GROUP, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "kept", "in_lang_all")],
        number.alias("i"), F.count("*").over(Window.partitionBy("lang")).alias("sources"))
    groups = c.staged(groups.withColumn("zero", F.coalesce(share("0", "total", "kept"), F.lit(0))), "groups")

    numbered = cells.join(groups.select(*GROUP, "i", "total", "kept"), GROUP).select(
        "lang", "term", "i", share("n", "total", "kept").alias("p"))
    one = groups.select("lang", "i", "source", "kept", F.col("zero").alias("p"))
    two = groups.select("lang", F.col("i").alias("j"), F.col("source").alias("item"), F.col("zero").alias("q"))
    pairs = pair_sums(numbered, groups).filter("i <> j").join(one, ["lang", "i"]).join(two, ["lang", "j"]).select(
        *GROUP, F.lit("pair").alias("part"), "item",
        (F.col("value") + (F.col("kept") - F.col("seen")) * F.abs(F.col("p") - F.col("q"))).alias("value"))

    width = c.width(docs.sparkSession)
    salt = F.pmod(F.xxhash64("term"), F.lit(max(1, round(width ** 0.5))))
    band = skybands(skybands(cells, top).repartition(width, *GROUP, salt), top).repartition(width, *GROUP)
    above = skybands(band, top).join(groups, GROUP).select(
        *GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        (share("n", "total", "kept") - share("in_lang", "in_lang_all", "kept")).alias("value")).filter("value > 0")
    rank = F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item"))
    both = pairs.unionByName(above).withColumn("rank", rank)
    return both.filter((F.col("part") == "pair") | (F.col("rank") <= top))
