"""Token counts by greedy longest match, in time linear in the text, without building a piece.

The vocabulary is a trie. A node v has a failure link and a count of popped tokens: if the text goes
on with a letter that v has no edge for, the longest tokens at the front of v's string are dropped, as
many as the count says, and matching goes on at the link, which stands for what is left of the string.
So no letter is read twice and tokens are only counted. Words of a batch walk the automaton together.

Words are those of the tokenizer file (see `lexicon.pieces`); a word's last letter is marked as its end,
as in the vocabulary. All bytes are in the vocabulary, so every word is covered. A null or empty text has
no word and no token; special strings count as one token.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from countylens.llm import common as c
from countylens.llm.lexicon import CACHE_WORDS, END, Vocabulary, pieces

ENDING = 256  # added to the byte that ends a word


class LongestMatch:
    """Edges sorted by node and symbol, failure links and popped-token counts."""

    def __init__(self, vocabulary: Vocabulary):
        of_letter = {s: b for b, s in enumerate(vocabulary.letters)}
        edges: list[dict[int, int]] = [{}]
        token = [False]
        for entry in vocabulary.ids:
            ends = entry.endswith(END) and entry != END
            symbols = [of_letter[s] for s in (entry[:-len(END)] if ends else entry)]
            if ends:
                symbols[-1] += ENDING
            node = 0
            for s in symbols:
                if s not in edges[node]:
                    edges[node][s] = len(edges)
                    edges.append({})
                    token.append(False)
                node = edges[node][s]
            token[node] = True
        link, popped = [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in edges[u].items():
                queue.append(v)
                if token[v]:
                    link[v], popped[v] = 0, 1
                    continue
                z, n = link[u], popped[u]
                while z >= 0 and s not in edges[z]:
                    n += popped[z]
                    z = link[z]
                if z >= 0:
                    link[v], popped[v] = edges[z][s], n
        flat = sorted((u * 512 + s, v) for u, out in enumerate(edges) for s, v in out.items())
        self.keys = np.array([k for k, _ in flat], np.int64)
        self.targets = np.array([v for _, v in flat], np.int64)
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, -1 where the vocabulary cannot cover it."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        length = np.array([len(w) for w in words])
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(length) - length
        symbols[(begin + length - 1)[length > 0]] += ENDING
        live = np.flatnonzero(length > 0)
        state = np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            todo = live
            while len(todo):
                want = state[todo] * 512 + symbols[begin[todo] + step]
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                ok = self.keys[at] == want
                state[todo[ok]] = self.targets[at[ok]]
                todo = self._fail(todo[~ok], state, out)
            live = live[(out[live] >= 0)]
            step += 1
            live = live[length[live] > step]
        rest = np.flatnonzero((length > 0) & (out >= 0))
        while len(rest := rest[state[rest] > 0]):
            rest = self._fail(rest, state, out)
        return out

    def _fail(self, rows: np.ndarray, state: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Pops tokens and follows the links; rows that have none left are not covered."""
        stuck = self.link[state[rows]] < 0
        out[rows[stuck]] = -1
        rows = rows[~stuck]
        out[rows] += self.popped[state[rows]]
        state[rows] = self.link[state[rows]]
        return rows


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text"
                 ) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_tokens": pa.int64()}

    def rows(parts):
        own = Vocabulary(vocabulary)
        match = LongestMatch(own)
        known: dict[str, int] = {}
        for part in parts:
            names, texts = (col.to_pylist() for col in part.columns)
            for at in range(0, len(names), 100):
                cut = [pieces(x, own) for x in texts[at:at + 100]]
                if len(known) > CACHE_WORDS or not known:
                    known = dict.fromkeys(own.specials, 1)
                new = list({w for t in cut for w in t} - known.keys())
                known.update(zip(new, match.counts([w.encode() for w in new]).tolist()))
                for name, t in zip(names[at:at + 100], cut):
                    yield name, len(t), sum(map(known.__getitem__, t))

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(
        lambda parts: c.batches(kinds, rows(parts)),
        "doc_id bigint, n_words bigint, n_tokens bigint")
