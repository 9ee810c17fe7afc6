"""Quality rules: robust multivariate outliers.

Each document has a vector of transformed statistics. For every language and source, every language, and all
documents the minimum covariance determinant estimate is found by concentration steps over all documents
of the group: keep the share H of documents nearest in Mahalanobis distance, take their mean and covariance,
repeat until these no longer change, STEPS times at most. Steps start once from medians and quartiles and once from the plain mean
and covariance; the smaller determinant wins. All steps are sums per group, added up before each
shuffle; the cut at H comes from a histogram of distances in fine logarithmic bins, so no group is ever sorted or
collected. A group that is settled is not read again.

Covariances take the factor that makes them right for normal data. A group of n kept documents counts
n / (n + PRIOR) and its parent's estimate the rest: source in language, language in all, all in FLOORS alone. So small
groups lean on larger ones by degrees, at no size by a switch. FLOORS are the least deviations of each
statistic, so that one that hardly varies does not reject on its own. A document is rejected beyond the
1 - TAIL quantile of the chi-squared distribution with as many degrees as statistics.

A null text has no word and fails the base rules; a text of any length is read whole, one at a time. Null
languages and sources are groups of their own. Repeated rows count as often as they come. An empty table gives an
empty result.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from countylens.llm import common as c

H, STEPS, PRIOR, TAIL = 0.75, 8, 70.0, 1e-6
LOTS = 32  # a group's rows are dealt to so many tasks where its estimate is joined by a shuffle
FLOORS = {"size": 0.5, "length": 0.1, "symbols": 0.4, "lines": 0.4, "repeats": 0.1, "upper": 0.4,
          "marks": 0.3}
NAMES = tuple(FLOORS)
P = len(NAMES)
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\t\n\x0b\x0c\r"
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi_squared(share: float, degrees: int) -> float:
    """Quantile by the cube root of Wilson and Hilferty."""
    k = 2 / (9 * degrees)
    return degrees * (1 - k + NormalDist().inv_cdf(share) * k ** 0.5) ** 3


def consistency(share: float, degrees: int) -> float:
    """How much larger a normal sample's covariance is than that of its share nearest to the middle."""
    k = 2 / (9 * (degrees + 2))
    x = chi_squared(share, degrees) / (degrees + 2)
    return share / NormalDist().cdf((x ** (1 / 3) - 1 + k) / k ** 0.5)


CUT = chi_squared(1 - TAIL, P)


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    h = c.word_hashes(data)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            repeated += line in seen
            seen.add(line)
    windows = c.shingles(h, 3)
    again = 0
    if len(windows):
        _, where, n = np.unique(windows, return_inverse=True, return_counts=True)
        again = int(c.covered(np.flatnonzero(n[where] > 1), 3, len(h)).sum())
    return (len(h), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            repeated, again)


_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2


def further_statistics(text: str | None) -> tuple[int, int]:
    """Upper-case letters A-Z and ASCII marks."""
    kinds = np.bincount(_KIND[np.frombuffer((text or "").encode(), np.uint8)], minlength=3)
    return int(kinds[1]), int(kinds[2])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and the transformed vector."""
    kinds = {"doc_id": pa.int64(), "lang": pa.string(), "source": pa.string()} | {
        n: pa.int64() for n in (*BASE, "n_upper", "n_marks")}

    def rows(parts):
        for part in parts:
            for i, lang, source, x in zip(*(col.to_pylist() for col in part.columns)):
                yield i, lang, source, *base_statistics(x), *further_statistics(x)

    counted = docs.select(F.col("doc_id").cast("bigint"), "lang", "source", "text").mapInArrow(
        lambda parts: c.batches(kinds, rows(parts)),
        "doc_id bigint, lang string, source string, "
        + ", ".join(f"{n} bigint" for n in (*BASE, "n_upper", "n_marks")))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.select(
        "doc_id", "lang", "source", *BASE,
        F.log1p("n_words").alias("size"), F.log(chars / n).alias("length"),
        F.log1p(1000 * F.col("n_symbols") / chars).alias("symbols"),
        F.log1p("n_dup_lines").alias("lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("repeats"),
        F.log1p(100 * F.col("n_upper") / chars).alias("upper"),
        F.log1p(100 * F.col("n_marks") / chars).alias("marks"))


def _group(*names: str) -> Column:
    """A name of the group; null values are left out, so they differ from all others."""
    return F.to_json(F.struct(F.lit(len(names)).alias("level"), *names))


def distance() -> Column:
    """Squared Mahalanobis distance from `mean` and `inverse`, the upper triangle row by row."""
    off = [F.col(n) - F.col("mean")[k] for k, n in enumerate(NAMES)]
    return sum(((1 if i == j else 2) * F.col("inverse")[k] * off[i] * off[j]
                for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def bin_of(d: Column) -> Column:
    return F.floor(32 * F.log2(d + 1e-6)).cast("int")


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i, j in PAIRS])


def square(triangle: list[float]) -> np.ndarray:
    """A symmetric matrix from its upper triangle row by row."""
    out = np.zeros((P, P))
    for v, (i, j) in zip(triangle, PAIRS):
        out[i, j] = out[j, i] = v
    return out


def triangle(matrix: np.ndarray) -> list[float]:
    return [float(matrix[i, j]) for i, j in PAIRS]


FLOOR = np.diag(np.square(list(FLOORS.values())))


def estimates(of: DataFrame) -> DataFrame:
    """(g, start, n, mean, inverse, spread, size) from n, sums and sums of products.

    spread is the covariance, inverse that of the covariance with the floors, size the log of its determinant.
    """
    kinds = {"g": pa.string(), "start": pa.int32(), "n": pa.int64(), "mean": pa.list_(pa.float64()),
             "inverse": pa.list_(pa.float64()), "spread": pa.list_(pa.float64()), "size": pa.float64()}

    def rows(parts):
        for part in parts:
            for r in part.to_pylist():
                mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                spread = square([r[f"q{i}_{j}"] / r["n"] for i, j in PAIRS]) - np.outer(mean, mean)
                whole = spread + FLOOR
                yield (r["g"], r["start"], r["n"], mean.tolist(), triangle(np.linalg.inv(whole)),
                       triangle(spread), float(np.linalg.slogdet(whole)[1]))

    return of.mapInArrow(lambda parts: c.batches(kinds, rows(parts)),
                         "g string, start int, n bigint, mean array<double>, inverse array<double>, "
                         "spread array<double>, size double")


def started(rows: DataFrame) -> DataFrame:
    """First estimates: medians with variances from quartiles, and the plain mean and covariance."""
    quartiles = [F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(n) for n in NAMES]
    per = rows.groupBy("g").agg(F.count("*").alias("n"), *quartiles)
    variance = {n: F.pow((F.col(n)[2] - F.col(n)[0]) / 1.349, 2) + FLOORS[n] ** 2 for n in NAMES}
    middle = per.select("g", F.lit(0).alias("start"), F.array(*[F.col(n)[1] for n in NAMES]).alias("mean"), F.array(*[
        1 / variance[NAMES[i]] if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"))
    plain = estimates(sums(rows, "g").withColumn("start", F.lit(1)))
    return middle.unionByName(plain.select(*middle.columns))


def nearest(rows: DataFrame, share: float) -> DataFrame:
    """(g, start) with n, sums and sums of products of the share of its documents that is nearest.

    Sums are made per bin of distances, so that one read gives the bin that holds the share and what lies up to it.
    """
    bins = sums(rows.withColumn("bin", bin_of(distance())), "g", "start", "bin")
    whole = Window.partitionBy("g", "start")
    bins = bins.withColumns({  # as many rows as bins, under 3,000
        "before": F.sum("n").over(whole.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(whole)})
    added = [n for n in bins.columns if n not in ("g", "start", "bin", "before", "all")]
    return bins.filter(F.col("before") < share * F.col("all")).groupBy("g", "start").agg(
        *[F.sum(n).alias(n) for n in added])


def in_lots(few: DataFrame) -> DataFrame:
    """Every row once for each lot."""
    return few.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))


def covariance_estimates(rows: DataFrame, steps: int = STEPS, share: float = H) -> DataFrame:
    """(g, n, mean, spread) for every group g of the rows, which are dealt to lots: n documents were kept."""
    now = c.staged(started(rows), "estimates")
    found: list[DataFrame] = []
    for step in range(steps):
        # `now` holds the groups that still change, a row each and start.
        apart = rows.join(in_lots(now.select("g", "start", "mean", "inverse")), ["g", "lot"])
        old = now.select("g", "start", F.col("mean").alias("old_mean"), F.col("inverse").alias("old_inverse"))
        moved = F.exists(F.arrays_zip("mean", "old_mean"), lambda v: F.abs(v["mean"] - v["old_mean"]) > 1e-7) | \
            F.exists(F.arrays_zip("inverse", "old_inverse"), lambda v: F.abs(v["inverse"] - v["old_inverse"]) > 1e-5 * (
                1 + F.abs(v["old_inverse"])))
        new = c.staged(estimates(nearest(apart, share)).join(old, ["g", "start"]).withColumn(
            "moved", moved).drop("old_mean", "old_inverse"), "estimates")
        last = step == steps - 1
        found.append((new if last else new.filter("not moved")).select("g", "start", "n", "mean", "spread", "size"))
        now = new.filter("moved")
        if last or now.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min_by(F.struct("n", "mean", "spread"), F.struct("size", "start"))
    return every.groupBy("g").agg(best.alias("b")).select("g", "b.*")


def leaning(found: DataFrame, groups: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(g, mean, inverse) of the groups (g, m, a), with those of their languages m and of all, a, mixed in."""
    factor = consistency(H, P)
    kinds = {"g": pa.string(), "mean": pa.list_(pa.float64()), "inverse": pa.list_(pa.float64())}

    def rows(parts):
        for part in parts:
            for r in part.to_pylist():
                mean, spread = None, np.zeros((P, P))
                for level in (r["all"], r["mid"], r["fine"]):
                    own = level["n"] / (level["n"] + prior)
                    at = np.array(level["mean"])
                    mean = at if mean is None else own * at + (1 - own) * mean
                    spread = own * factor * square(level["spread"]) + (1 - own) * spread
                yield r["g"], mean.tolist(), triangle(np.linalg.inv(spread + FLOOR))

    def of(level: str, key: str) -> DataFrame:
        return found.select(F.col("g").alias(key), F.struct("n", "mean", "spread").alias(level))

    return groups.join(of("fine", "g"), "g").join(of("mid", "m"), "m").join(of("all", "a"), "a").select(
        "g", "fine", "mid", "all").mapInArrow(lambda parts: c.batches(kinds, rows(parts)),
                                              "g string, mean array<double>, inverse array<double>")


def judged(docs: DataFrame, cut: float = CUT, prior: float = PRIOR) -> DataFrame:
    """doc_id, lang, source, base statistics, base_failed, distance and kept of every row."""
    groups = {"g": _group("lang", "source"), "m": _group("lang"), "a": _group()}
    rows = c.staged(statistics(docs).withColumns(groups | {
        "lot": F.pmod(F.monotonically_increasing_id(), F.lit(LOTS)).cast("int")}), "statistics")
    levels = rows.select(F.explode(F.array(*groups)).alias("g"), "lot", *NAMES)
    found = c.staged(covariance_estimates(levels), "estimates")
    models = c.staged(leaning(found, rows.select(*groups).distinct(), prior), "models")
    far = rows.join(in_lots(models), ["g", "lot"]).withColumn("distance", distance())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return far.select("doc_id", "lang", "source", *BASE, failed.alias("base_failed"), "distance", (
        ~failed & (F.col("distance") <= cut)).alias("kept"))
