"""Bags of words and topic models.

A model is a table: per word its weight in every topic. It is fitted by variational Bayes with symmetric
priors of one over the number of topics. Texts are dealt into blocks, once: a block has a list of its words, and a
row per text with the places of the text's words in that list and their counts, packed into a byte or two each. In
each step the words of every block are joined with the weights, so a word's weights travel once per block, not once
per text; per text, the shares of its topics are settled (numpy on some texts at a time); what each word adds to
each topic is summed up per block, then per word. Neither words nor weights are ever brought together: the
driver sees one number per topic. What a step shuffles is removed when its weights are written.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from countylens import storage
from countylens.functions import measures, stems, texts
from countylens.operators import words

TOPICS = 10
PASSES = 10
TERMS_SHOWN = 10
# Sweeps over a text's words, and the mean change of its weights below which it has settled.
SWEEPS, SETTLED = 50, 1e-3
# Words of a block that are handled at a time, beyond those of the last text.
HELD = 1 << 16
# Words of a block, nearly, at most, and at least as long as there are blocks for all cores: the larger the blocks,
# the fewer of them share a word and take its weights.
BLOCK, SMALL = 1 << 23, 1 << 19
# Rows of a bag that are packed at a time.
CHUNK = 1 << 20
# Words of texts from so many are summed by a product of matrices per text; those of shorter ones all at once.
LONG = 64


def bag_of_words(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                 *, stopwords: Iterable[str]) -> DataFrame:
    """How often each topic word occurs in each text. Topic models want a longer list of stopwords
    than word counts do, so there is no default."""
    found = docs.select(doc, F.explode(texts.letter_runs(F.col(text))).alias("word"))
    return (found.filter(texts.is_topic_word(F.col("word"), stopwords))
            .groupBy(doc, "word").agg(F.count("*").alias("count")))


@dataclass(frozen=True)
class BlockedBag:
    """A bag whose texts are dealt into blocks and stored, to be used more than once.

    ``texts`` has a row per text with known words, (doc, _block, places, counts), the last two packed lists; ``uses`` has
    a row for every word of a block, (_block, place, word, count). The blocks of a batch have numbers in a row.
    """

    texts: DataFrame
    uses: DataFrame
    doc: str
    whole: bool  # counts are whole numbers
    batches: int
    blocks: int  # in each batch

    def batch(self, at: int) -> BlockedBag:
        if self.batches == 1:
            return self
        own = F.col("_block").between(at * self.blocks, (at + 1) * self.blocks - 1)
        return replace(self, texts=self.texts.filter(own), uses=self.uses.filter(own))


def blocked(bag: DataFrame, doc: str = "doc_id", batch: float = 1.0, seed: int = 0, folder: str | None = None) -> BlockedBag:
    """The texts of a bag (doc, word, count) in blocks. Blocks hold whole texts; ``batch`` and ``seed`` as in ``fit``.

    The bag is read once and written out for it; rows then go to their blocks packed, a chunk of a task's rows for
    each block. A block's rows are in one task.
    """
    spark = bag.sparkSession
    folder = folder or storage.work_folder(spark, "blocked")
    kinds = dict(bag.dtypes)
    whole = kinds["count"] in ("tinyint", "smallint", "int", "bigint")
    rows = storage.staged(bag.select(doc, "word", F.col("count").cast("bigint" if whole else "double").alias("count")),
                          f"{folder}/bag", "zstd")
    batches, size = max(1, round(1 / batch)), rows.count()
    blocks = max(1, -(-size // (batches * BLOCK)), min(
        2 * spark.sparkContext.defaultParallelism, -(-size // (batches * SMALL))))
    dealt = F.pmod(F.xxhash64(F.lit(seed), F.col(doc)), F.lit(batches)) * blocks + F.pmod(
        F.xxhash64(F.lit("block"), F.col(doc)), F.lit(blocks))
    packed = rows.withColumn("_block", dealt.cast("bigint")).mapInArrow(_chunked(doc), "_block bigint, chunk binary")
    schema = (f"`{doc}` {kinds[doc]}, _block bigint, places binary, counts binary, place int, word string, "
              f"count {'bigint' if whole else 'double'}")
    stored = storage.staged(packed.groupBy("_block").applyInArrow(_gathered(doc, whole), schema), f"{folder}/blocks", "zstd")
    storage.remove(spark, f"{folder}/bag")
    return BlockedBag(stored.filter("places IS NOT NULL").select(doc, "_block", "places", "counts"),
                      stored.filter("places IS NULL").select("_block", "place", "word", "count"),
                      doc, whole, batches, blocks)


def _chunked(doc: str):
    """Rows of a task, some at a time, as a packed table for each of their blocks."""
    def cut(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("_block", "ascending"), (doc, "ascending")])).combine_chunks()
        block = rows.column("_block").to_numpy()
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        chunks = []
        for a, b in zip(starts, [*starts[1:], len(block)]):
            docs, word, count = (pa.concat_arrays(rows.column(c).slice(a, b - a).chunks) for c in (doc, "word", "count"))
            part = pa.record_batch({"doc": docs.dictionary_encode(), "word": word.dictionary_encode(), "count": count})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(part)
            chunks.append(out.getvalue().to_pybytes())
        return pa.record_batch({"_block": pa.array(block[starts]), "chunk": pa.array(chunks, pa.binary())})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + batch.num_rows
            if size >= CHUNK:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    return found


def _gathered(doc: str, whole: bool):
    """The chunks of a block as its texts, in order, and its words, the most frequent first."""
    names = [doc, "_block", "places", "counts", "place", "word", "count"]

    def found(chunks: pa.Table) -> pa.Table:
        block = chunks.column("_block")[0].as_py()
        rows = pa.concat_tables([pa.ipc.open_stream(c.as_buffer()).read_all() for c in chunks.column("chunk")])
        rows = rows.unify_dictionaries()
        docs, named = (rows.column(c).chunk(0).dictionary for c in ("doc", "word"))
        code, of = (np.concatenate([np.asarray(c.indices.fill_null(len(c.dictionary))) for c in rows.column(k).chunks])
                    for k in ("doc", "word"))  # what is null has the last number
        docs = pa.concat_arrays([docs, pa.nulls(1, docs.type)])
        count = rows.column("count").to_numpy()
        if whole and np.abs(count).max() < 1 << 31:
            count = count.astype(np.int32)
        del rows
        total = np.zeros(len(named) + 1, np.int64 if whole else float)
        np.add.at(total, of, count)
        order = np.lexsort((np.argsort(np.asarray(pc.sort_indices(named))), -total[:-1]))
        place = np.empty(len(named) + 1, np.int32)
        place[order], place[-1] = np.arange(len(named)), len(named)
        listed = np.append(order, len(named)) if (of == len(named)).any() else order
        parts = [pa.table([
            pa.nulls(len(listed), docs.type), pa.array(np.full(len(listed), block)), pa.nulls(len(listed), pa.binary()),
            pa.nulls(len(listed), pa.binary()), pa.array(place[listed]),
            named.take(pa.array(listed, mask=listed == len(named))), pa.array(total[listed])], names=names)]

        # rows of a null word are not among those of texts
        if len(listed) > len(order):
            code, of, count = (x[of < len(named)] for x in (code, of, count))
        ranked = np.asarray(pc.sort_indices(docs)).astype(np.int32)
        code, at = np.argsort(ranked).astype(np.int32)[code], place[of]
        del of
        order = np.lexsort((at, code))
        sizes = np.bincount(code, minlength=len(docs))
        texts_ = np.flatnonzero(sizes)
        starts = np.append(0, np.cumsum(sizes[texts_]))
        first = 0
        while first < len(texts_):  # some texts at a time
            behind = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, "right")) - 1)
            own, spans = order[starts[first]:starts[behind]], starts[first:behind] - starts[first]
            gaps, n, size = np.diff(at[own], prepend=0), count[own], behind - first
            gaps[spans] = at[own[spans]]
            parts.append(pa.table([
                docs.take(pa.array(ranked[texts_[first:behind]])), pa.array(np.full(size, block)), _packed(gaps, spans),
                _packed(n, spans) if whole else _slices(n.astype("<f8").view(np.uint8), spans * 8),
                pa.nulls(size, pa.int32()), pa.nulls(size, pa.string()), pa.nulls(size, parts[0].column("count").type)],
                names=names))
            first = behind
        return pa.concat_tables(parts)

    return found


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of whole numbers as bytes: seven bits in each, the lowest first, and a bit that says whether more follow."""
    left = values.astype(np.int64).view(np.uint64)
    size, more = np.ones(len(left), np.int64), left >> np.uint64(7)
    while more.any():
        size += more > 0
        more >>= np.uint64(7)
    ends = np.cumsum(size)
    first, out = ends - size, np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    live = np.arange(len(left))
    for k in range(int(size.max()) if len(size) else 0):
        live = live[size[live] > k]
        byte = (left[live] >> np.uint64(7 * k)) & np.uint64(127)
        out[first[live] + k] = byte.astype(np.uint8) + (size[live] > k + 1) * np.uint8(128)
    return _slices(out, first[starts])


def _slices(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of lists packed by ``_packed``, one list after the other."""
    ends = np.flatnonzero(data < 128)
    first = np.append(0, ends[:-1] + 1)[:len(ends)]
    size = ends - first + 1
    values = (data[first] & 127).astype(np.int64)
    live = np.arange(len(ends))
    for k in range(1, int(size.max()) if len(size) else 0):
        live = live[size[live] > k]
        values[live] |= (data[first[live] + k] & 127).astype(np.int64) << (7 * k)
    return values


def normalize(bag: DataFrame | BlockedBag, lexicon: DataFrame, doc: str = "doc_id") -> DataFrame | BlockedBag:
    """Words replaced by their base form, words outside the lexicon kept.

    The lexicon is of any size: Spark broadcasts it while small, else shuffles both sides and
    splits hot words, since the regrouping by text shuffles anew anyway. Of a bag in blocks only the words of
    blocks are replaced: a base form then has several places in a block, whose counts add up in all that
    is fitted.
    """
    forms = lexicon.groupBy("word").agg(F.min("base").alias("base"))
    if isinstance(bag, BlockedBag):
        return replace(bag, uses=bag.uses.join(forms, "word", "left").select(
            "_block", "place", F.coalesce("base", "word").alias("word"), "count"))
    return (bag.join(forms, "word", "left")
            .groupBy(doc, F.coalesce("base", "word").alias("word"))
            .agg(F.sum("count").alias("count")))


def base_forms(bag: DataFrame) -> DataFrame:
    """A lexicon for ``normalize``: every distinct word with its base form by rules, for English."""
    return stems.with_stems(bag.select("word").distinct())


def vocabulary(bag: DataFrame) -> DataFrame:
    """Every word with its total count and its number, 0 for the most frequent."""
    totals = bag.groupBy("word").agg(F.sum("count").alias("count"))
    return words.word_ranks(totals).select((F.col("rank") - 1).alias("word_id"), "word", "count")


def numbered(bag: DataFrame, terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The bag by numbers of a vocabulary; words outside it are left out. The bag is not sorted for it."""
    return bag.join(terms.select("word", "word_id").hint("shuffle_hash"), "word").select(doc, "word_id", "count")


def vectors(bag: DataFrame, terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A text's words as two lists, numbers in order and counts. Texts without known words are left out.

    Rows are dealt by text before they are gathered: lists of parts of texts would be sorted, and written
    where they do not fit, on both sides of the shuffle."""
    pairs = F.array_sort(F.collect_list(F.struct("word_id", "count")))
    held = numbered(bag, terms, doc).repartition(doc).groupBy(doc).agg(pairs.alias("pairs"))
    return held.select(doc, F.col("pairs.word_id").alias("word_ids"), F.col("pairs.count").alias("counts"))


@dataclass(frozen=True)
class TopicModel:
    """``weights`` holds (word_id, word, weights), a weight per topic; ``totals`` their sums over all words."""

    weights: DataFrame
    totals: tuple[float, ...]

    @property
    def topics(self) -> int:
        return len(self.totals)

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> TopicModel:
    weights = spark.read.parquet(path)
    return TopicModel(weights, _totals(weights))


def fit(bag: DataFrame | BlockedBag, doc: str = "doc_id", topics: int = TOPICS, passes: int = PASSES,
        batch: float = 1.0, seed: int = 0) -> TopicModel:
    """Topics of the texts of a bag (doc, word, count), or of one in blocks.

    ``batch`` is the share of texts per step: with 1 every step sees all texts and replaces the weights;
    with less, texts are dealt into batches by a hash, and a step moves the weights towards what its
    batch says, early steps most. All texts are seen ``passes`` times. Draws are hashes of word and
    topic, so a fit does not depend on how rows lie. A step's weights are written out and the ones
    before are removed, so the plan does not grow and a lost executor costs a part of one step.
    """
    spark = bag.texts.sparkSession if isinstance(bag, BlockedBag) else bag.sparkSession
    folder = storage.work_folder(spark, "topics")
    held = bag if isinstance(bag, BlockedBag) else blocked(bag, doc, batch, seed, folder)
    if held.batches != max(1, round(1 / batch)):
        raise ValueError(f"the bag is in {held.batches} batches, not in those of {batch}")
    held = replace(held, uses=storage.staged(held.uses, f"{folder}/uses", "zstd"))
    weights = storage.staged(vocabulary(held.uses).select("word_id", "word", _start("word", topics, seed).alias("weights")),
                             f"{folder}/weights-0")
    prior, totals = 1 / topics, _totals(weights, topics)
    for step in range(passes * held.batches):
        before = f"{folder}/weights-{step}"
        found = additions(held.batch(step % held.batches), _factors(weights, totals), topics)
        pace = 1.0 if held.batches == 1 else (1 + step) ** -0.5
        # one sum of what is kept of a word's weights and what blocks add; a word of no block has a row by the first
        kept = weights.select("word_id", "word", *[
            ((1 - pace) * F.col("weights")[k] + pace * prior).alias(f"_t{k}") for k in range(topics)])
        added = found.select(F.lit(None).cast("bigint").alias("word_id"), "word", *[
            (pace * held.batches * F.col(f"_t{k}")).alias(f"_t{k}") for k in range(topics)])
        moved = kept.unionAll(added).groupBy("word").agg(
            F.max("word_id").alias("word_id"), *[F.sum(f"_t{k}").alias(f"_t{k}") for k in range(topics)])
        weights = storage.staged(moved.select("word_id", "word", F.array(*[f"_t{k}" for k in range(topics)]).alias("weights")),
                                 f"{folder}/weights-{step + 1}")
        totals = _totals(weights, topics)
        storage.remove(spark, before)
    for done in ("blocks", "uses"):
        storage.remove(spark, f"{folder}/{done}")
    return TopicModel(weights, totals)


def additions(held: BlockedBag, factors: DataFrame, topics: int) -> DataFrame:
    """What each word of a block adds to each topic: (word, _t0, _t1, ...), a row for each place in a block."""
    whole = held.whole

    def found(block: pa.Table, known: pa.Table) -> pa.Table:
        sums = np.zeros((topics, known.num_rows))
        for _, _, at, count, factor, starts in _texts_of(block, known, topics, whole):
            share, _ = _settled(count, factor, starts, topics)
            for k in range(topics):
                sums[k] += np.bincount(at, count * share[:, k], known.num_rows)
        return pa.table({"word": known.column("known")} | {f"_t{k}": pa.array(sums[k]) for k in range(topics)})

    kinds = ", ".join(f"_t{k} double" for k in range(topics))
    return _by_block(held.texts, held.uses, factors).applyInArrow(found, f"word string, {kinds}")


def assign(bag: DataFrame | BlockedBag, model: TopicModel, doc: str = "doc_id") -> DataFrame:
    """The share of every topic in every text: (doc, topic, share). Texts without known words are left out."""
    topics, given = model.topics, isinstance(bag, BlockedBag)
    doc = bag.doc if given else doc
    kind = dict((bag.texts if given else bag).dtypes)[doc]
    schema = f"`{doc}` {kind}, topic int, share double"
    if not topics:
        return (bag.texts if given else bag).sparkSession.createDataFrame([], schema)
    held = bag if given else blocked(bag, doc)
    whole = held.whole

    def found(block: pa.Table, known: pa.Table) -> pa.Table:
        parts = [pa.table({doc: block.column(doc).slice(0, 0), "topic": pa.array([], pa.int32()),
                           "share": pa.array([], pa.float64())})]
        for docs, spans, _, count, factor, starts in _texts_of(block, known, topics, whole):
            _, gamma = _settled(count, factor, starts, topics)
            gamma = gamma / gamma.sum(axis=1, keepdims=True)
            parts.append(pa.table({
                doc: docs.take(pa.array(np.repeat(spans, topics))),
                "topic": pa.array(np.tile(np.arange(topics, dtype=np.int32), len(spans))),
                "share": pa.array(gamma.ravel())}))
        return pa.concat_tables(parts)

    return _by_block(held.texts, held.uses, _factors(model.weights, model.totals)).applyInArrow(found, schema)


def _by_block(rows: DataFrame, uses: DataFrame, factors: DataFrame):
    """The texts of each block beside the factors of its words."""
    # named anew, as rows and uses may come from one scan
    known = uses.select(F.col("_block").alias("_of"), "place", F.col("word").alias("_word")).join(
        factors.withColumnRenamed("word", "_word"), "_word").select("_of", "place", F.col("_word").alias("known"), "factors")
    return rows.groupBy("_block").cogroup(known.groupBy("_of"))


def _texts_of(block: pa.Table, known: pa.Table, topics: int, whole: bool):
    """Whole texts, some at a time: their names, the places of the texts among these, the rows of the words among the known
    ones, counts, factors and first words. Texts are in order, and words within them."""
    if not block.num_rows or not known.num_rows:
        return
    place = known.column("place").to_numpy()
    factors = known.column("factors").combine_chunks().flatten().to_numpy().reshape(-1, topics)
    block = block.take(pc.sort_indices(block.column(0))).combine_chunks()
    docs = pa.concat_arrays(block.column(0).chunks)
    (places, bounds), (counts, spans) = (_bytes(block.column(c)) for c in ("places", "counts"))
    ends = np.append(0, np.cumsum(np.add.reduceat(places < 128, bounds[:-1], dtype=np.int64)))
    row = np.full(max(int(place.max()) + 1, 1), -1)
    row[place] = np.arange(len(place))
    first = 0
    while first < len(docs):
        behind = max(first + 1, int(np.searchsorted(ends, ends[first] + HELD, "right")) - 1)
        gaps = _unpacked(places[bounds[first]:bounds[behind]])
        data = counts[spans[first]:spans[behind]]
        count = (_unpacked(data) if whole else np.frombuffer(data.tobytes(), "<f8")).astype(float)
        starts, sizes = ends[first:behind] - ends[first], np.diff(ends[first:behind + 1])
        runs = np.cumsum(gaps)
        at = runs - np.repeat(runs[starts] - gaps[starts], sizes)
        at = np.where(at < len(row), row[np.minimum(at, len(row) - 1)], -1)
        text = np.repeat(np.arange(first, behind), sizes)
        if at.min() < 0:
            keep = at >= 0
            at, count, text = at[keep], count[keep], text[keep]
        if len(at):
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            yield docs, text[starts], at, count, factors[at], starts
        first = behind


def _bytes(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of packed lists and where each list begins, and the last ends."""
    held = pa.concat_arrays(packed.chunks)
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1].astype(np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _settled(count: np.ndarray, factor: np.ndarray, starts: np.ndarray, topics: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the topics in every word, and the weights of the topics in every text, once they settle."""
    prior, n = 1 / topics, len(starts)
    sizes = np.diff(starts, append=len(count))
    total = np.add.reduceat(count, starts)
    gamma = np.repeat((prior + total / topics)[:, None], topics, axis=1)
    live = np.flatnonzero(sizes >= LONG)
    texts_ = [(factor[a:b], count[a:b]) for a, b in zip(starts[live], starts[live] + sizes[live])]
    for _ in range(SWEEPS if len(live) else 0):
        theta = np.exp(digamma(gamma[live]))
        new = prior + theta * np.array([(c / (f @ t + 1e-100)) @ f for (f, c), t in zip(texts_, theta)])
        moving = np.abs(new - gamma[live]).mean(axis=1) > SETTLED
        gamma[live] = new
        if not moving.any():
            break
        live, texts_ = live[moving], [x for x, m in zip(texts_, moving) if m]
    live = np.flatnonzero(sizes < LONG)
    of = np.repeat(np.arange(len(live)), sizes[live])
    row = np.flatnonzero(np.repeat(sizes < LONG, sizes))
    for _ in range(SWEEPS if len(live) else 0):
        theta = np.exp(digamma(gamma[live]))
        f = factor[row]
        mass = np.einsum("ij,ij->i", theta[of], f) + 1e-100
        first = np.flatnonzero(np.diff(of, prepend=-1))
        new = prior + theta * np.add.reduceat((count[row] / mass)[:, None] * f, first)
        moving = np.abs(new - gamma[live]).mean(axis=1) > SETTLED
        gamma[live] = new
        if not moving.any():
            break
        rows_moving = moving[of]
        row, of = row[rows_moving], np.cumsum(moving)[of[rows_moving]] - 1
        live = live[moving]
    share = np.exp(digamma(gamma))[np.repeat(np.arange(n), sizes)] * factor
    return share / (share.sum(axis=1, keepdims=True) + 1e-100), gamma


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma, for x > 0: moved up by six, then its asymptotic series."""
    low = sum(1 / (x + k) for k in range(6))
    y = 1 / (x + 6)
    z = y * y
    return np.log(x + 6) - y / 2 - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240))) - low


def _start(word: str, topics: int, seed: int) -> Column:
    """First weights: normal draws of mean 1 and deviation 0.1 from hashes of word and topic."""
    def uniform(k: int, draw: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.lit(draw), F.col(word)), 11)
        return (bits.cast("double") + 0.5) / float(1 << 53)

    return F.array(*[1 + 0.1 * F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * np.pi * uniform(k, 1))
                     for k in range(topics)])


def _factors(weights: DataFrame, totals: Iterable[float]) -> DataFrame:
    """How much each topic favours a word: the exponent of its expected log weight."""
    whole = digamma(np.maximum(list(totals), 1e-100))
    return weights.select("word", F.array(*[
        F.exp(measures.digamma(F.col("weights")[k]) - float(t)) for k, t in enumerate(whole)]).alias("factors"))


def _totals(weights: DataFrame, topics: int | None = None) -> tuple[float, ...]:
    if topics is None:
        found = weights.select(F.size("weights").alias("n")).first()
        topics = found.n if found else 0
    if not topics:
        return ()
    sums = weights.agg(*[F.sum(F.col("weights")[k]).alias(f"_t{k}") for k in range(topics)]).first()
    return tuple(s or 0.0 for s in sums)


def describe(model: TopicModel, shown: int = TERMS_SHOWN) -> DataFrame:
    """The heaviest words of every topic with their shares; equal ones in word order.

    Each task sends at most ``shown`` words per topic.
    """
    share = F.transform("weights", lambda w, k: w / F.array(*map(F.lit, model.totals))[k])
    per_topic = model.weights.select("word", F.posexplode(share).alias("topic", "weight"))
    heaviest = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    return (per_topic.withColumn("rank", F.row_number().over(heaviest)).filter(F.col("rank") <= shown)
            .select("topic", "rank", "word", "weight"))


def topic_lines(described: DataFrame) -> DataFrame:
    """One line per topic, such as ``0.031*"word" + 0.020*"other"``."""
    term = F.format_string('%.3f*"%s"', "weight", "word")
    in_order = F.array_sort(F.collect_list(F.struct("rank", term.alias("term"))))
    return described.groupBy("topic").agg(
        F.array_join(F.transform(in_order, lambda t: t["term"]), " + ").alias("words"))
