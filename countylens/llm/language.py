"""Language identification with interpolated Kneser-Ney models of characters.

Texts are lower-cased, runs of anything but letters become one blank, and blanks are put around. The n-grams of ORDER
characters of every learning document are counted on the executors, in numpy, and summed up by Spark
per language. From all of them follow, by joins and sums over tables, the continuation counts of the lower orders,
the totals and kinds of each context, and an interpolated Kneser-Ney probability for each n-gram.

Then n-grams go that hardly matter: those whose share of a language's n-grams times the bits they save
against the shorter context is under LEAST. What they held is given to the weight that their context leaves
to shorter ones, so that probabilities still add up to 1. The shares of an order add up to 1 and no n-gram
saves more bits than its probability lies above the least one, so some tens over LEAST is the most that a
language can keep, however large the corpus; the rule is the same at every size and all counts are whole.
What is kept is a sorted array of n-gram hashes per order, with a row of log probabilities per language. A
document gets the language of least cross-entropy per character, over its whole text.

Rejection is calibrated: a model that lacks a sixteenth of the learning documents shows on these how the margin
between the best two languages, times the square root of the characters, relates to being right. The score is
that probability, and `accepted` is whether it reaches ACCEPT; the language is named either way. The model in use
then learns from all of them.

A null text or one without a letter is `und` with score 0. Documents without a language, or held out,
teach nothing. If nothing can be learned, everything is `und`; an empty table gives an empty result. Repeated rows
count as often as they come; a tie goes to the first language by name. Texts are read one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from countylens.llm import common as c

ORDER, LEAST, DISCOUNT, ACCEPT, UNKNOWN = 4, 2e-6, 0.75, 0.5, "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words between single blanks; empty if there is no letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if any(map(str.isalpha, words)) else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


_PLACE = c.numbers(31, 16) | np.uint64(1)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n code points."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = points[:m] * _PLACE[0]
    for j in range(1, n):
        total = total + points[j:j + m] * _PLACE[j]
    return c.mix(total)


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, aside, gram, n) summed over all rows of (lang, aside, text)."""
    def counts(parts) -> Iterator[pa.RecordBatch]:
        for part in parts:
            of: dict[tuple[str, bool], list[np.ndarray]] = {}
            for lang, aside, text in zip(*(col.to_pylist() for col in part.columns)):
                points = codes(letters(text))
                if len(points) >= order:
                    of.setdefault((lang, aside), []).append(points)
            for (lang, aside), many in of.items():
                yield from batch(lang, aside, many)

    def batch(lang, aside, many):
        # Separate texts by 0, which no text holds once cleaned, and drop the runs across.
        joined = np.concatenate([x for t in many for x in (t, np.zeros(1, np.uint64))])
        m = len(joined) - order + 1
        whole = np.lib.stride_tricks.sliding_window_view(joined == 0, order).any(axis=1)
        at = np.flatnonzero(~whole[:m])
        found, first, n = np.unique(gram_hashes(joined, order)[at], return_index=True,
                                    return_counts=True)
        runs = joined[at[first][:, None] + np.arange(order)].astype("<u4")
        grams = [r.tobytes().decode("utf-32-le") for r in runs]
        yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()),
                               "aside": pa.array([aside] * len(grams), pa.bool_()),
                               "gram": pa.array(grams, pa.string()), "n": pa.array(n, pa.int64())})

    return docs.mapInArrow(counts, "lang string, aside boolean, gram string, n bigint").groupBy(
        "lang", "aside", "gram").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, order: int = ORDER, least: float = LEAST) -> tuple[DataFrame, DataFrame, float]:
    """(k, lang, gram, p), (k, lang, head, left) and the probability below all, from (lang, gram, n).

    p is the interpolated probability of a gram's last character after the others, for grams that are kept; left
    is what a context leaves to shorter ones, for contexts with a gram that is kept.
    """
    levels = {order: counts}
    for k in range(order, 1, -1):  # of how many different characters a shorter run is the continuation
        levels[k - 1] = c.staged(levels[k].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(
            F.count("*").alias("n")), "continuations")
    base = 1.0 / (levels[1].select("gram").distinct().count() + 1)
    grams, lefts = [], []
    lower = None
    for k in range(1, order + 1):
        head, tail = F.substring("gram", 1, k - 1), F.substring("gram", 2, k)
        rows = levels[k].withColumns({"head": head, "tail": tail})
        contexts = rows.groupBy("lang", "head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        every = contexts.groupBy("lang").agg(F.sum("total").alias("all"))
        rows = rows.join(contexts, ["lang", "head"]).join(every, "lang")
        # shorter: of the whole model; short: of the one that is kept
        rows = rows.withColumns({"shorter": F.lit(base), "short": F.lit(base)}) if lower is None else rows.join(
            lower, ["lang", "tail"])
        own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        backed = DISCOUNT * F.col("kinds") / F.col("total") * F.col("shorter")
        bits = F.col("n") / F.col("all") * F.log2((own + backed) / backed)
        rows = c.staged(rows.withColumns({"p": own + backed, "kept": (bits >= least) | F.lit(k == 1)}), "order")
        some = [F.sum(F.when(F.col("kept"), F.col(x))).alias(y) for x, y in (("p", "held"), ("short", "would"))]
        plain = F.first(DISCOUNT * F.col("kinds") / F.col("total"))
        left = c.staged(rows.groupBy("lang", "head").agg(
            *some, plain.alias("plain"), F.min("kept").alias("whole"), F.max("kept").alias("any")).filter("any").select(
            "lang", "head", _left(k).alias("left")), "left")
        grams.append(rows.filter("kept").select(F.lit(k).alias("k"), "lang", "gram", "p"))
        lefts.append(left.select(F.lit(k).alias("k"), "lang", "head", "left"))
        lower = rows.join(left, ["lang", "head"], "left").select(
            "lang", F.col("gram").alias("tail"), F.col("p").alias("shorter"), F.when(F.col("kept"), F.col("p")).otherwise(
                F.coalesce("left", F.lit(1.0)) * F.col("short")).alias("short"))
    return reduce(DataFrame.unionByName, grams), reduce(DataFrame.unionByName, lefts), base


def _left(k: int) -> Column:
    """What the kept grams of a context do not hold, over what shorter contexts say of all others."""
    if k == 1:
        return F.col("plain")
    return F.greatest(1 - F.col("held"), F.lit(1e-12)) / F.greatest(1 - F.col("would"), F.lit(1e-12))


class Model:
    """Sorted hashes and log probabilities per language, by order."""

    def __init__(self, grams: pd.DataFrame, lefts: pd.DataFrame, base: float, order: int):
        self.order = order
        self.langs = sorted(grams.lang.unique())
        self.base = np.float32(np.log2(base))
        self.known = round(1 / base) - 1  # characters met
        self.hashes: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []    # log2 P of the run's last character after the others
        self.contexts: list[np.ndarray] = []
        self.left: list[np.ndarray] = []    # log2 of the weight a context leaves to shorter ones
        place = {lang: j for j, lang in enumerate(self.langs)}
        runs: dict[int, set[str]] = {order + 1: set()}
        for k in range(order, 0, -1):  # with the ends of longer runs, for languages that do not know these
            runs[k] = set(grams.gram[grams.k == k]) | {g[1:] for g in runs[k + 1]}
        lower = None
        for k in range(1, order + 1):
            own, rest = grams[grams.k == k], lefts[lefts.k == k]
            heads = sorted(set(rest["head"]))
            left = np.ones((len(heads) + 1, len(self.langs)))  # the last row: a context that is not known
            at = {h: j for j, h in enumerate(heads)}
            left[rest["head"].map(at), rest.lang.map(place)] = rest.left
            names = sorted(runs[k])
            where = {g: j for j, g in enumerate(names)}
            short = base if lower is None else lower[1][[lower[0][g[1:]] for g in names]]
            value = left[[at.get(g[:-1], -1) for g in names]] * short
            value[own.gram.map(where), own.lang.map(place)] = own.p
            lower = where, value
            for keys, values, to, into in ((names, value, self.hashes, self.logs),
                                           (heads, left[:-1], self.contexts, self.left)):
                h = _of_rows(codes("".join(keys)).reshape(len(keys), -1)) if keys and keys[-1] else np.zeros(
                    len(keys), np.uint64)
                into.append(np.log2(values[np.argsort(h)]).astype(np.float32))
                to.append(np.sort(h))

    def _find(self, table: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(table, want), len(table) - 1)
        return at, table[at] == want

    def entropy(self, points: np.ndarray) -> np.ndarray:
        """Bits per character in each language."""
        runs, n = self._runs(points)
        total = np.zeros(len(self.langs))
        weight = n.astype(np.float64)
        added = np.zeros((len(runs), len(self.langs)), np.float32)
        live = np.arange(len(runs))
        for k in range(self.order, 0, -1):
            tail = runs[live, self.order - k:]
            at, ok = self._find(self.hashes[k - 1], _of_rows(tail))
            total += weight[live[ok]] @ (self.logs[k - 1][at[ok]] + added[live[ok]])
            live, tail = live[~ok], tail[~ok]
            if not len(live):
                break
            if k > 1:
                at, ok = self._find(self.contexts[k - 1], _of_rows(tail[:, :-1]))
                added[live[ok]] += self.left[k - 1][at[ok]]
            else:
                added[live] += self.left[0][0]
        total += weight[live] @ (added[live] + self.base)
        return -total / weight.sum()

    def _runs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(points) < self.order:  # a text of one letter: a blank on either side is too few
            points = np.concatenate([np.full(self.order - len(points), 32, np.uint64), points])
        h = gram_hashes(points, self.order)
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        return points[first[:, None] + np.arange(self.order)], n


def _of_rows(runs: np.ndarray) -> np.ndarray:
    return c.mix((runs * _PLACE[:runs.shape[1]]).sum(axis=1, dtype=np.uint64))


def margin(bits: np.ndarray, n: int) -> float:
    """How clearly the best language stands out, in a text of n characters."""
    low = np.sort(bits)
    return float((low[1] - low[0]) * np.sqrt(n)) if len(low) > 1 else float("inf")


def logistic(margins: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(right) in log(1 + margin); one prior case of each kind."""
    x = np.append(np.log1p(margins), [0.0, 3.0])
    y = np.append(right.astype(float), [0.5, 1.0])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 1e-2 * a, (y - p).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, b


def built(counts: DataFrame, order: int, least: float) -> Model | None:
    grams, lefts, base = probabilities(counts, order, least)
    known = grams.toPandas()  # some tens over `least` rows per language at most
    return Model(known, lefts.toPandas(), base, order) if len(known) else None


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: Column | None = None,
          order: int = ORDER, least: float = LEAST, calibrate: int = 20_000):
    """(model, slope, offset) from rows with a language; None if there is none.

    Calibration takes the `calibrate` rows of lowest hash at most, of a sixteenth of the rows by `key`.
    """
    h = F.xxhash64(key if key is not None else F.col(text))
    known = docs.filter(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"),
        (F.pmod(h, F.lit(16)) == 0).alias("aside"))
    parts = c.staged(gram_counts(known.select("lang", "aside", "text"), order), "grams")
    whole = built(c.staged(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"), order, least)
    model = whole and built(parts.filter("not aside").select("lang", "gram", "n"), order, least)
    if model is None:
        return whole and (whole, 1.0, 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def margins(parts):
        def rows():
            for part in parts:
                for name, x, at in zip(*(col.to_pylist() for col in part.columns)):
                    points = codes(letters(x))
                    if len(points):
                        bits = sent.value.entropy(points)
                        yield (at, margin(bits, len(points)),
                               sent.value.langs[int(bits.argmin())] == name)
        yield from c.batches({"h": pa.int64(), "m": pa.float64(), "right": pa.bool_()}, rows())

    tried = known.filter("aside").select("lang", "text", "h").mapInArrow(
        margins, "h bigint, m double, right boolean").orderBy("h", "m", "right").limit(
        calibrate).toPandas()
    tried = tried[np.isfinite(tried.m)]
    slope, offset = logistic(tried.m.to_numpy(float), tried.right.to_numpy(bool))
    return whole, slope, offset


def predicted(docs: DataFrame, learned, doc_id: str = "doc_id", text: str = "text",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, further columns of the rows, lang_pred, score, accepted and bits per character."""
    rows_ = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "accepted": pa.bool_(),
             "bits": pa.float64()}

    def guess(x):
        points = codes(letters(x)) if sent.value else ()
        if not len(points):
            return UNKNOWN, 0.0, False, None
        model, slope, offset = sent.value
        bits = model.entropy(points)
        far = min(margin(bits, len(points)), 1e6)
        score = float(1 / (1 + np.exp(-(slope * np.log1p(far) + offset))))
        return model.langs[int(bits.argmin())], score, score >= ACCEPT, float(bits.min())

    def rows(parts):
        for part in parts:
            out = [guess(x) for x in part.column("text").to_pylist()]
            part = part.drop_columns(["text"])
            for name, values in zip(kinds, zip(*out) if out else [()] * len(kinds)):
                part = part.append_column(name, pa.array(values, kinds[name]))
            yield part

    schema = rows_.drop("text").schema
    for name, kind in zip(kinds, ("string", "double", "boolean", "double")):
        schema = schema.add(name, kind)
    return rows_.mapInArrow(rows, schema)
