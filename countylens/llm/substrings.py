"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus in order (doc_id, then place). It is indexed in blocks: the index
is a table of word windows, dealt over Spark partitions by hash, and a block holds for each of its
windows the place where that sequence of words starts first. A document is factored greedily against
all blocks: from a place whose window starts earlier elsewhere a factor grows word by word for as
long as the window ending at the next word is found too. Where a factor ends, every window across
its boundary is looked up on its own, so that spans meeting at a boundary lose no word. Factors have
at least `window` words and become duplicate spans.

Only windows that can repeat are indexed. Each window is represented by its lowest-hashed run of
`gram` words; equal windows have equal representatives, so one met once in the corpus rules out all
its windows. Representatives are about a seventh of the words and are counted before anything else
is shuffled.

Rows are told apart by doc_id and text; equal rows count as one document and get equal results.
Null ids come last in the order. A null or short text has no factor and is left as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from countylens.llm import common as c

KEY = ["__i", "__t"]


def representatives(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the words of some texts: hash and place of the representatives, and for each the text and the
    first and last window it stands for. Places are counted over all these texts."""
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    grams = c.shingles(hashes, gram)
    last_window = np.repeat(ends - window, np.diff(ends, prepend=0))[:len(hashes) - window + 1]
    start = np.flatnonzero(np.arange(len(last_window)) <= last_window)  # windows inside one text
    if not len(start):
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    pick = (sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(len(last_window)))[start]
    text = np.searchsorted(ends, start, "right")
    begin = np.flatnonzero((np.diff(pick, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(begin[1:], len(pick)) - 1
    at = pick[begin]
    return grams[at], at, text[begin], start[begin], start[last]


def candidate_windows(hashes: np.ndarray, ends: np.ndarray, window: int, gram: int, hits: np.ndarray) -> np.ndarray:
    """Starts of the windows whose representative, by place, is one of the hits."""
    _, at, _, first, last = representatives(hashes, ends, window, gram)
    chosen = np.isin(at, hits)
    first, size = first[chosen], last[chosen] - first[chosen] + 1
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def candidates(texts: pa.BinaryArray, hits: pa.ListArray, window: int, gram: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes of some texts, where each text ends, and of each candidate window its start, counted
    over all, and its text. Hits are counted in their own text."""
    hashes, ends = c.hashed(texts)
    begins = np.concatenate([[0], ends[:-1]])
    places = _flat(hits, begins)
    starts = candidate_windows(hashes, ends, window, gram, places)
    return hashes, ends, starts, np.searchsorted(ends, starts, "right")


def _flat(lists: pa.ListArray, shift: np.ndarray) -> np.ndarray:
    """The numbers of all lists, each moved by its list's shift."""
    sizes = np.nan_to_num(np.asarray(pc.list_value_length(lists), float)).astype(np.int64)
    return np.asarray(lists.flatten()).astype(np.int64) + np.repeat(shift, sizes)


def parse(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors (first word, words) from the windows found earlier in the reference."""
    if not len(starts):
        return []
    begin = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
    end = np.append(begin[1:], len(starts)) - 1
    return [(int(starts[a]), int(starts[b] - starts[a]) + window) for a, b in zip(begin, end)]


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20,
            gram: int = 8) -> DataFrame:
    """The given columns, keys `__i`, `__t`, and arrays `__hits`, `__firsts` for `apply_factors`.

    Shuffled: one hash per representative to count them, the same with keys to find the repeated
    ones, the windows of those, and the rows themselves once.
    """
    rows = docs.withColumns(c.key_columns(doc_id, text))
    texts = rows.select(*KEY, F.col(text).cast("binary").alias("text"))

    def hashes_only(parts):
        for part in parts:
            for a, b in c.pieces(part.column(0)):
                found = representatives(*c.hashed(part.column(0)[a:b]), window, gram)[0]
                if len(found):
                    yield pa.record_batch({"rep": pa.array(found.view(np.int64))})

    def places(parts):
        for part in parts:
            for a, b in c.pieces(part.column("text")):
                hashes, ends = c.hashed(part.column("text")[a:b])
                rep, at, of, *_ = representatives(hashes, ends, window, gram)
                if len(rep):
                    of_text = pa.array(of)
                    yield pa.record_batch({
                        "rep": pa.array(rep.view(np.int64)), "__i": part.column("__i")[a:b].take(of_text),
                        "__t": part.column("__t")[a:b].take(of_text),
                        "at": pa.array((at - np.concatenate([[0], ends[:-1]])[of]).astype(np.int32))})

    def windows(parts):
        for part in parts:
            column = part.column(text).cast(pa.binary())
            for a, b in c.pieces(column):
                hashes, ends, starts, of = candidates(column[a:b], part.column("__hits")[a:b], window, gram)
                if not len(starts):
                    continue
                found = c.shingles(hashes, window)[starts]
                order = np.lexsort((starts, found, of))  # each window of a text once, where it starts first
                new = np.append(True, (np.diff(found[order].view(np.int64)) != 0) | (np.diff(of[order]) != 0))
                order = order[new]
                of_text = pa.array(of[order])
                yield pa.record_batch({
                    "h": pa.array(found[order].view(np.int64)), "__i": part.column("__i")[a:b].take(of_text),
                    "__t": part.column("__t")[a:b].take(of_text),
                    "start": pa.array((starts - np.concatenate([[0], ends[:-1]])[of])[order].astype(np.int32))})

    repeated = c.staged(
        texts.select("text").mapInArrow(hashes_only, "rep bigint").groupBy("rep")
        .agg(F.count("*").alias("n")).filter("n > 1").select("rep"), "repeated")
    places_ = texts.mapInArrow(places, "rep bigint, __i bigint, __t bigint, at int")
    hits = c.staged(
        places_.join(repeated, "rep", "left_semi").groupBy(*KEY)
        .agg(F.collect_set("at").alias("__hits")), "hits")
    # The same columns as in the last join, so that both read one shuffle of the rows.
    found = rows.join(hits, KEY).mapInArrow(
        windows, "h bigint, __i bigint, __t bigint, start int")
    index = found.groupBy("h").agg(F.min(F.struct(
        c.late().alias("late"), "__i", "__t", "start")).alias("at"))
    firsts = index.groupBy(F.col("at.__i").alias("__i"), F.col("at.__t").alias("__t")).agg(
        F.collect_set("at.start").alias("__firsts"))
    return rows.join(hits.join(firsts, KEY, "left"), KEY, "left")


def repeats(texts: pa.BinaryArray, hits: pa.ListArray, firsts: pa.ListArray, window: int, gram: int
            ) -> list[list[tuple[int, int]]]:
    """The factors of each text: candidate windows less those that start first here."""
    hashes, ends, starts, of = candidates(texts, hits, window, gram)
    begins = np.concatenate([[0], ends[:-1]])
    later = ~np.isin(starts, _flat(firsts, begins))
    starts, of = starts[later] - begins[of[later]], of[later]
    edges = np.searchsorted(of, np.arange(len(ends) + 1))
    return [parse(np.sort(starts[a:b]), window) for a, b in zip(edges[:-1], edges[1:])]


def factors_of(part: pa.RecordBatch, text: str, window: int, gram: int) -> Iterator[list[tuple[int, int]]]:
    """The factors of every row of a batch, texts with hits hashed together."""
    column, hits, firsts = part.column(text).cast(pa.binary()), part.column("__hits"), part.column("__firsts")
    some = pc.is_valid(hits)
    chosen = column.filter(some)
    found = (spans for a, b in c.pieces(chosen) for spans in repeats(
        chosen[a:b], hits.filter(some)[a:b], firsts.filter(some)[a:b], window, gram))
    for has in some.to_pylist():
        yield next(found) if has else []


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the spans of words; what stands between other words is kept."""
    if not spans:
        return text
    marks = [m.span() for m in re.finditer(c.WORD_RUN, text)]
    out, at = [], 0
    for start, n in merged(spans):
        cut = marks[start][0]
        out.append(text[at:cut])
        at = marks[start + n][0] if start + n < len(marks) else marks[-1][1]
    return "".join(out) + text[at:]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet or overlap, joined."""
    out: list[list[int]] = []
    for start, n in spans:
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n - out[-1][0])
        else:
            out.append([start, n])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20,
          gram: int = 8) -> DataFrame:
    """The documents with every factor cut out of the text; other columns, whatever their names, and rows stay."""
    plain, (i, words) = c.by_position(docs, doc_id, text)
    parsed = factors(plain, i, words, window, gram)

    def cut(parts):
        for part in parts:
            spans = factors_of(part, words, window, gram)
            left = [without(t, s) if s else t for t, s in zip(part.column(words).to_pylist(), spans)]
            at = part.schema.get_field_index(words)
            yield part.set_column(at, words, pa.array(left, pa.string())).drop_columns(["__hits", "__firsts"])

    shown = parsed.select(*plain.columns, "__hits", "__firsts")
    return shown.mapInArrow(cut, plain.schema).toDF(*docs.columns)


def digest(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the factors of every document."""
    parsed = factors(docs.select("doc_id", "text"), window=window, gram=gram).select(
        "doc_id", "text", "__hits", "__firsts")
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(),
             "kept_sha256": pa.string(),
             "factors": pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))}

    def rows(parts):
        for part in parts:
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for i, x, spans in zip(part.column("doc_id").to_pylist(), texts, factors_of(part, "text", window, gram)):
                tokens = x.split() if x else []
                kept, at = [], 0
                for start, n in merged(spans):
                    kept += tokens[at:start]
                    at = start + n
                kept += tokens[at:]
                yield (i, len(tokens), len(tokens) - len(kept), c.sha256(b" ".join(kept)),
                       [{"start": s, "length": n} for s, n in spans])

    return parsed.mapInArrow(
        lambda parts: c.batches(kinds, rows(parts)),
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
        "factors array<struct<start:int,length:int>>")
