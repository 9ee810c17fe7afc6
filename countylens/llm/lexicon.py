"""Byte-pair encoding and decoding with a minimal acyclic transducer of frequent words.

The frequent words of the corpus, counted over all documents, are encoded once and compiled into a
minimal acyclic automaton: states with equal futures are one, so suffixes are shared. Every edge
carries how many words are passed over by taking it; their sum along a word is the word's place in
the list of id outputs. The automaton is a few flat arrays in one file of the shared folder, which
Spark ships to every executor and the workers memory-map. A batch's distinct words walk it together, one byte a step.
Words that it lacks are merged exactly, by the ranks of the vocabulary file.

Texts are prepared as the tokenizer file says: its special strings first, then NFC, lower case
character by character, and the split into contractions, letters, single digits and the rest. A null
or empty text has no ids and decodes to the empty text. `LEXICON_WORDS` words of at most
`LEXICON_LETTERS` letters bound the automaton, and `CACHE_WORDS` what a worker remembers; none of them
changes a result.
"""

from __future__ import annotations

import functools
import heapq
import io
import json
import os
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from countylens.llm import common as c
from countylens.session import shared_dir

LEXICON_WORDS = 1 << 16
LEXICON_LETTERS = 64
CACHE_WORDS = 500_000
END = "</w>"
PIECES = regex.compile(
    r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: The same for lower-case ASCII.
PLAIN_PIECES = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x20\x09-\x0Da-z0-9]+")
SHORT, NO_MERGE = 64, (1 << 40, -1)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What the tokenizer file holds, and exact merging of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.ids: dict[str, int] = held["model"]["vocab"]
        self.ranks = {tuple(m): r for r, m in enumerate(held["model"]["merges"])}
        self.specials = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {
            i: t for t, i in self.specials.items()}
        self.letters = byte_letters()
        self.pairs = {(self.ids[a], self.ids[b]): (r, self.ids[a + b])
                      for (a, b), r in self.ranks.items()}
        self.inner = [self.ids[s] for s in self.letters]
        self.final = [self.ids[s + END] for s in self.letters]
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(
            self.specials, key=len, reverse=True)) or r"(?!)")

    def merge(self, word: str) -> list[int]:
        """Ids of one word: again and again the adjacent pair of lowest rank, leftmost first."""
        raw = word.encode()
        return self._merge_short(raw) if len(raw) <= SHORT else self._merge_long(raw)

    def _merge_short(self, raw: bytes) -> list[int]:
        """Looks through all pairs at each step."""
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        get = self.pairs.get
        pairs = [get(pair, NO_MERGE) for pair in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) is not NO_MERGE:
            k = pairs.index(best)
            parts[k:k + 2] = [best[1]]
            del pairs[k]
            if k:
                pairs[k - 1] = get((parts[k - 1], best[1]), NO_MERGE)
            if k < len(pairs):
                pairs[k] = get((best[1], parts[k + 1]), NO_MERGE)
        return parts

    def _merge_long(self, raw: bytes) -> list[int]:
        """Keeps the pairs in a heap, so that time stays near linear."""
        parts = [self.letters[b] for b in raw]
        parts[-1] += END
        follow = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = [(self.ranks[pair], k) for k, pair in enumerate(zip(parts, parts[1:]))
                if pair in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            after = follow[k]
            if after < 0 or self.ranks.get((parts[k], parts[after])) != rank:
                continue  # one of its ends has been merged meanwhile
            parts[k], parts[after] = parts[k] + parts[after], ""
            follow[k], follow[after] = follow[after], -1
            if follow[k] >= 0:
                before[follow[k]] = k
            for left in (before[k], k):
                right = follow[left] if left >= 0 else -1
                if right >= 0 and (parts[left], parts[right]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[parts[left], parts[right]], left))
        return [self.ids[p] for p in parts if p in self.ids]


def prepared(text: str) -> list[str]:
    """Words of a text without special strings."""
    if text.isascii():
        return PLAIN_PIECES.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower() alone would look at its neighbours
        text = text.replace("Σ", "σ")
    return PIECES.findall(text.lower())


def pieces(text: str | None, vocabulary: Vocabulary) -> list[str]:
    """Words and special strings of a text, in order."""
    if not text:
        return []
    if "<|" not in text:
        return prepared(text)
    out, at = [], 0
    for match in vocabulary.split.finditer(text):
        out += prepared(text[at:match.start()])
        out.append(match.group())
        at = match.end()
    return out + prepared(text[at:])


class Lexicon:
    """The automaton over flat arrays: edges sorted by state and byte, targets, words passed over."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, outputs: dict[bytes, list[int]]) -> Lexicon:
        """Compiles words, taken in byte order; a state is closed, and shared if an equal one is
        known, as soon as no later word can pass through it."""
        known: dict[tuple, int] = {}
        closed: list[tuple[bool, list[tuple[int, int]]]] = []
        path: list[list] = [[False, []]]  # accepts, edges of the open states
        labels: list[int] = []

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                accepts, edges = path.pop()
                key = (accepts, *edges)
                if key not in known:
                    known[key] = len(closed)
                    closed.append((accepts, edges))
                path[-1][1].append((labels.pop(), known[key]))

        words = sorted(outputs)
        before = b""
        for word in words:
            same = len(os.path.commonprefix([before, word]))
            close(same)
            for b in word[same:]:
                path.append([False, []])
                labels.append(b)
            path[-1][0] = True
            before = word
        close(0)
        closed.append((path[0][0], path[0][1]))
        reach = np.zeros(len(closed), np.int64)
        keys, targets, passed = [], [], []
        for state, (accepts, edges) in enumerate(closed):  # targets come before their sources
            total = int(accepts)
            for label, target in edges:
                keys.append(state * 256 + label)
                targets.append(target)
                passed.append(total)
                total += int(reach[target])
            reach[state] = total
        ids = [outputs[w] for w in words]
        return cls({
            "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32),
            "passed": np.array(passed, np.int32), "root": np.array([len(closed) - 1]),
            "accepts": np.array([a for a, _ in closed], bool),
            "ends": np.cumsum([len(x) for x in ids]).astype(np.int64),
            "ids": np.array([i for x in ids for i in x], np.int32)})

    def written(self) -> bytes:
        """The arrays, one after another."""
        file = io.BytesIO()
        for name in ("keys", "targets", "passed", "root", "accepts", "ends", "ids"):
            np.save(file, self.__dict__[name])
        return file.getvalue()

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Maps the file; only pages that words pass through are read."""
        arrays = {}
        with open(path, "rb") as file:
            for name in ("keys", "targets", "passed", "root", "accepts", "ends", "ids"):
                np.lib.format.read_magic(file)
                shape, _, dtype = np.lib.format.read_array_header_1_0(file)
                arrays[name] = np.memmap(path, dtype, "r", file.tell(), shape) \
                    if shape[0] else np.zeros(0, dtype)
                file.seek(dtype.itemsize * shape[0], os.SEEK_CUR)
        return cls(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the list of outputs, -1 where the automaton lacks it."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words])
        begin = np.cumsum(length) - length
        live = np.flatnonzero(length > 0)
        state = np.full(len(live), self.root[0], np.int64)
        rank = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            want = state * 256 + raw[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            live, at, rank = live[ok], at[ok], rank[ok]
            state, rank = self.targets[at].astype(np.int64), rank + self.passed[at]
            step += 1
            done = length[live] == step
            hit = done & self.accepts[state]
            out[live[hit]] = rank[hit]
            live, state, rank = live[~done], state[~done], rank[~done]
        return out

    def output(self, place: int) -> list[int]:
        start = self.ends[place - 1] if place else 0
        return self.ids[start:self.ends[place]].tolist()


def frequent_words(docs: DataFrame, vocabulary: str, text: str = "text",
                   most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents that occur twice or more: at most `most` of at most
    LEXICON_LETTERS letters reach the driver."""
    from collections import Counter

    def counts(parts):
        own = vocabulary_of(vocabulary)
        for part in parts:
            found = Counter()
            for x in part.column(0).to_pylist():
                found.update(pieces(x, own))
            yield from c.batches({"word": pa.string(), "n": pa.int64()},
                                 ((w, n) for w, n in found.items() if w not in own.specials), 20000)

    counted = c.staged(
        docs.select(text).mapInArrow(counts, "word string, n bigint")
        .filter(F.length("word") <= LEXICON_LETTERS).groupBy("word")
        .agg(F.sum("n").alias("n")).filter("n > 1").withColumn("all", F.lit(0)), "words")
    return [r.word for r in c.most_frequent(counted, most, "all").select("word").collect()]


def compiled(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compiles the words and ships the file; its name among the files of the session."""
    own = Vocabulary(vocabulary)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file = store.create(path)
    file.write(bytearray(Lexicon.build({w.encode(): own.merge(w) for w in words}).written()))
    file.close()
    spark.sparkContext.addFile(store.makeQualified(path).toString())
    return name


@functools.lru_cache(2)
def vocabulary_of(path: str) -> Vocabulary:
    """One per worker, kept over its tasks."""
    return Vocabulary(path)


class Coder:
    """Encodes and decodes the words of batches of texts in one worker.

    A text's ids are those of its words in order, and so are its decoded tokens; both are kept by word,
    written out, and joined by a space, as the tokenizer file, which names no decoder, asks for.
    """

    def __init__(self, vocabulary: str, lexicon: str):
        self.vocabulary = vocabulary_of(vocabulary)
        self.lexicon = Lexicon.load(SparkFiles.get(lexicon))
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, str] = {}
        self.said: dict[str, str] = {}
        for special, i in self.vocabulary.specials.items():
            self._keep(special, [i])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids[word] = " ".join(map(str, ids))
        self.said[word] = " ".join(map(self.vocabulary.tokens.__getitem__, ids))

    def learn(self, texts: list[list[str]]) -> None:
        """Looks up every word of a batch that is not remembered."""
        if len(self.ids) > CACHE_WORDS:
            self._reset()
        new = list(set().union(*texts).difference(self.ids))
        for word, place in zip(new, self.lexicon.find([w.encode() for w in new])):
            self._keep(word, self.lexicon.output(int(place)) if place >= 0
                       else self.vocabulary.merge(word))

    def encode(self, text: list[str]) -> str:
        """The ids, in decimal, joined by a space."""
        return " ".join(map(self.ids.__getitem__, text))

    def decode(self, text: list[str]) -> str:
        return " ".join(map(self.said.__getitem__, text))


@functools.lru_cache(1)
def coder_of(vocabulary: str, lexicon: str) -> Coder:
    """One per worker, kept over its tasks."""
    return Coder(vocabulary, lexicon)


def encoded(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
            most: int = LEXICON_WORDS, digests: bool = False, keep: tuple[str, ...] = ()
            ) -> DataFrame:
    """doc_id, the string columns of keep, n_tokens and ids of every row; with digests ids_sha256 and
    decoded_sha256 in place of the ids."""
    lexicon = compiled(docs.sparkSession, frequent_words(docs, vocabulary, text, most), vocabulary)
    kinds = {"doc_id": pa.int64()} | {n: pa.string() for n in keep} | {"n_tokens": pa.int64()} | (
        {"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests
        else {"ids": pa.list_(pa.int32())})

    def rows(parts):
        coder = coder_of(vocabulary, lexicon)
        for part in parts:
            *names, texts = (col.to_pylist() for col in part.columns)
            names = list(zip(*names))
            for at in range(0, len(names), 100):
                cut = [pieces(x, coder.vocabulary) for x in texts[at:at + 100]]
                coder.learn(cut)
                for name, t in zip(names[at:at + 100], cut):
                    ids = coder.encode(t)
                    n = ids.count(" ") + 1 if t else 0
                    if digests:
                        yield (*name, n, c.sha256(ids.encode()),
                               c.sha256(coder.decode(t).encode()))
                    else:
                        yield *name, n, [int(i) for i in ids.split()]

    schema = ("doc_id bigint, " + "".join(f"`{n}` string, " for n in keep) + "n_tokens bigint, "
              + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), *keep, text).mapInArrow(
        lambda parts: c.batches(kinds, rows(parts), 500), schema)


def decoded(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The given columns and the decoded text of their ids; null ids decode to the empty text."""
    def texts(parts):
        own = vocabulary_of(vocabulary)
        for part in parts:
            out = [" ".join(own.tokens[i] for i in x or ()) for x in part.column(ids).to_pylist()]
            yield part.append_column("decoded", pa.array(out, pa.string()))

    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(texts, schema)
