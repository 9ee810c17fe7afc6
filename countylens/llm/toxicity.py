"""Toxicity as severity grades, by cumulative-link ordinal regression on sparse text features.

P(grade > k) = logistic(w x - t_k) for the ordered thresholds t_0 < t_1 < ...: all grades share the
weights w. Features are words and the fronts of words, lower-cased, as log(1 + occurrences), and the
log of the number of words. The learned labels are 0 and 1; a toxic text's grade, 1 to GRADES, comes from how
many marked words it holds (terciles), where a mark is a feature that goes with the label.

Bound: the model is fitted on at most SAMPLE labelled documents, those of lowest hash of the id, and
keeps at most FEATURES features. Scoring covers every document and its whole text.

The result is the expected severity, the sum of P(grade > k) over k, with the most likely grade; `toxic`
is P(grade > 0) >= CUT. A null or empty text has no feature but its length and is never toxic. With
no labelled document of both kinds, severity is 0 and nothing is toxic. Null labels and labels of unknown
documents teach nothing; a document with several labels counts as toxic if one says so.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from countylens.llm import common as c

SAMPLE, FEATURES, GRADES, CUT, CACHE_WORDS = 30_000, 8192, 3, 0.5, 300_000
FRONTS = (5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return ["=" + word] + ["^" + word[:k] for k in FRONTS if len(word) >= k]


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


class Severity:
    """Weights by feature, weight of the length, thresholds."""

    def __init__(self, weights: dict[str, float], length: float, thresholds: np.ndarray):
        self.weights, self.length, self.thresholds = weights, length, thresholds

    def probabilities(self, score: float) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most `most` labelled documents."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    chosen = (known.join(ids, "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", "text").join(
        F.broadcast(c.staged(chosen, "labelled")), "doc_id")  # `most` short rows at most


def feature_scores(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): texts of either kind that have it."""
    def counts(parts):
        for part in parts:
            of = (Counter(), Counter())
            for x, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                of[y > 0].update({f for w in word_counts(x) for f in features_of(w)})
            names = of[0].keys() | of[1].keys()
            yield from c.batches({"feature": pa.string(), "toxic": pa.int64(), "clean": pa.int64()},
                                 ((n, of[1][n], of[0][n]) for n in names), 20000)

    return rows.select("text", "toxic").mapInArrow(
        counts, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, features: int = FEATURES
        ) -> Severity | None:
    rows = c.staged(sample(docs, labels, most), "sample")
    kinds = {r.toxic > 0: r.n for r in rows.groupBy("toxic").agg(
        F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return None
    # Signed root of the likelihood ratio of how the texts with a feature divide over the two kinds.
    share = kinds[True] / (kinds[True] + kinds[False])
    seen = F.col("toxic") + F.col("clean")
    ratio = 2 * sum(F.when(n > 0, n * F.log(n / (seen * part))).otherwise(0.0) for n, part in (
        (F.col("toxic"), share), (F.col("clean"), 1 - share)))
    z = F.sqrt(F.greatest(ratio, F.lit(0.0))) * F.signum(F.col("toxic") - seen * share)
    chosen = (feature_scores(rows).filter(F.col("toxic") + F.col("clean") >= 4)
              .withColumn("z", z).filter(F.abs("z") > 4)
              .orderBy(F.desc(F.abs("z")), "feature").limit(features).toPandas())
    place = {f: k for k, f in enumerate(chosen.feature)}
    marks = set(chosen.feature[chosen.z > 6]) or set(chosen.feature[chosen.z > 0])

    def vectors(parts):
        def out():
            for part in parts:
                for x, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    found, marked, n = Counter(), 0, 0
                    for w, k in word_counts(x).items():
                        n += k
                        own = [f for f in features_of(w) if f in place]
                        marked += k * any(f in marks for f in own)
                        for f in own:
                            found[place[f]] += k
                    yield (y, marked, n, list(found), [float(np.log1p(k)) for k in found.values()])
        yield from c.batches({"toxic": pa.int32(), "marked": pa.int32(), "n": pa.int64(),
                              "at": pa.list_(pa.int32()), "x": pa.list_(pa.float64())}, out(), 500)

    held = rows.select("text", "toxic").mapInArrow(
        vectors, "toxic int, marked int, n bigint, at array<int>, x array<double>").toPandas()
    toxic = held.toxic.to_numpy() > 0
    steps = np.quantile(held.marked[toxic], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic, 1 + (held.marked.to_numpy()[:, None] > steps).sum(axis=1), 0)
    size = held["at"].map(len).to_numpy()
    row = np.repeat(np.arange(len(held)), size)
    at = np.concatenate([np.zeros(0, int), *held["at"]]).astype(int)
    x = np.concatenate([np.zeros(0), *held.x])
    length = np.log1p(held.n.to_numpy()) - 5
    w, thresholds = ordinal(row, at, x, length, grade, len(place))
    return Severity({f: float(w[k]) for f, k in place.items()}, float(w[-1]), thresholds)


def ordinal(row, at, x, length, grade, features, penalty=0.05, steps=400, rate=0.05):
    """Weights (the last is the length's) and ascending thresholds, by Adam on the whole sample."""
    n = len(grade)
    top = max(int(grade.max()), 1)
    above = (grade[:, None] > np.arange(top)).astype(float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    t0 = np.log((1 - share) / share)
    # Free parameters: weights, length, the first threshold and logs of the gaps.
    p = np.concatenate([np.zeros(features + 1), t0[:1], np.log(np.maximum(np.diff(t0), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        score = np.bincount(row, x * p[at], n) + length * p[features]
        gaps = np.exp(p[features + 2:])
        t = p[features + 1] + np.concatenate([[0.0], np.cumsum(gaps)])
        high = 1 / (1 + np.exp(np.clip(t - score[:, None], -50, 50)))  # P(grade > k)
        upper = np.concatenate([np.ones((n, 1)), high], axis=1)
        lower = np.concatenate([high, np.zeros((n, 1))], axis=1)
        k = np.arange(n), grade
        prob = np.maximum(upper[k] - lower[k], 1e-9)
        du, dl = upper[k] * (1 - upper[k]) / prob, lower[k] * (1 - lower[k]) / prob
        ds = -(du - dl)                                  # of the loss by the score
        dt = np.array([(du * (grade == j + 1) - dl * (grade == j)).sum() for j in range(top)])
        g = np.concatenate([
            np.bincount(at, x * ds[row], features) + penalty * p[:features],
            [(ds * length).sum() + penalty * p[features]], [dt.sum()],
            [gaps[j] * dt[j + 1:].sum() for j in range(top - 1)]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    gaps = np.exp(p[features + 2:])
    return p[:features + 1], p[features + 1] + np.concatenate([[0.0], np.cumsum(gaps)])


def graded(docs: DataFrame, model: Severity | None, keep: tuple[str, ...] = ("doc_id",),
           text: str = "text", cut: float = CUT) -> DataFrame:
    """The kept columns with severity, grade and toxic, a row per row of docs."""
    rows_ = docs.select(*keep, F.col(text).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"severity": pa.float64(), "grade": pa.int32(), "toxic": pa.bool_()}

    def grade(x, known):
        model = sent.value
        words = word_counts(x)
        if model is None or not words:
            return 0.0, 0, False
        found: Counter = Counter()
        n = 0
        for w, k in words.items():
            n += k
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(f for f in features_of(w) if f in model.weights)
            for f in own:
                found[f] += k
        score = sum(model.weights[f] * np.log1p(k) for f, k in found.items())
        high = model.probabilities(score + model.length * (np.log1p(n) - 5))
        return float(high.sum()), int((high >= 0.5).sum()), bool(high[0] >= cut)

    def rows(parts):
        known: dict[str, tuple] = {}
        for part in parts:
            out = []
            for x in part.column("__text").to_pylist():
                if len(known) > CACHE_WORDS:
                    known.clear()
                out.append(grade(x, known))
            part = part.drop_columns(["__text"])
            for name, values in zip(kinds, zip(*out) if out else [()] * len(kinds)):
                part = part.append_column(name, pa.array(values, kinds[name]))
            yield part

    schema = rows_.drop("__text").schema
    for name, kind in zip(kinds, ("double", "integer", "boolean")):
        schema = schema.add(name, kind)
    return rows_.mapInArrow(rows, schema)


def clean(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that are not toxic. Columns stay, whatever their names."""
    plain, (i, x) = c.by_position(docs, "doc_id", "text")
    model = fit(plain.select(F.col(i).alias("doc_id"), F.col(x).alias("text")), labels, most)
    kept = graded(plain, model, tuple(plain.columns), x).filter("not toxic")
    return kept.select(*plain.columns).toDF(*docs.columns)
