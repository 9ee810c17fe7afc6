"""Substring and near-duplicate dedup against brute force, with nulls, ties and repeated rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from countylens.llm import near_dups, substrings
from countylens.llm.components import components

SCHEMA = "doc_id bigint, text string, h string, node string"


def prose(seed, n):
    pick = random.Random(seed)
    return [f"w{pick.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base, shared, near = prose(1, 60), prose(2, 45), prose(3, 120)
    rows = [(1, " ".join(base)), (2, " ".join(prose(4, 10) + shared + prose(5, 10))),
            (3, "\n".join(shared + base[:30])), (4, " ".join(base)), (5, None), (6, ""), (7, " \t "),
            (8, "one"), (9, "ONE"), (10, " ".join(near)), (11, " ".join(near[:-4] + prose(6, 4))),
            (12, " ".join(shared[:25] + shared[:25])), (None, " ".join(base)), (None, None)]
    rows += [(100 + k, " ".join(near[:60] + [f"x{k}"] + near[61:])) for k in range(80)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns bear names that the operators use inside."""
    return spark.createDataFrame([(i, t, "h", "n") for i, t in texts], SCHEMA).repartition(3)


def brute_repeats(texts, window=20):
    seen, out = set(), {}
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        tokens = (text or "").encode().split()
        gone = [False] * len(tokens)
        for s in range(len(tokens) - window + 1):
            run = tuple(tokens[s:s + window])
            if run in seen:
                gone[s:s + window] = [True] * window
            seen.add(run)
        kept = b" ".join(t for t, g in zip(tokens, gone) if not g)
        out[i, text] = (len(tokens), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, texts):
    got = {(r.doc_id, r.n_words): r for r in substrings.digest(docs).collect()}
    want = brute_repeats(texts)
    assert len(want) == len(texts)
    for (i, text), (n, removed, kept) in want.items():
        row = got[i, n]
        assert (row.n_removed, row.kept_sha256) == (removed, kept), i


def test_cut_texts(docs, texts):
    cut = substrings.dedup(docs)
    assert cut.columns == docs.columns
    got = {(r.doc_id, r.text is None): r.text for r in cut.collect()}
    assert len(got) == len(texts)
    assert got[4, False] == "" and got[5, True] is None and got[7, False] == " \t "
    assert got[1, False] == dict(texts)[1]
    for (i, text), (n, removed, kept) in brute_repeats(texts).items():
        left = b" ".join((got[i, text is None] or "").encode().split())
        assert hashlib.sha256(left).hexdigest() == kept


def test_equal_rows_are_one_document(spark):
    text = " ".join(prose(7, 40))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substrings.digest(twice).collect())
    assert got == [(1, 0), (1, 0), (2, 40)]


def test_factors_are_greedy():
    import numpy as np

    assert substrings.parse(np.array([0, 1, 2, 7, 30]), 20) == [(0, 22), (7, 20), (30, 20)]
    assert substrings.merged([(0, 22), (7, 20), (30, 20)]) == [(0, 27), (30, 20)]


def brute_components(texts, words):
    def shingles(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        k = min(words, len(low))
        return frozenset(tuple(low[s:s + k]) for s in range(len(low) - k + 1)) if k else frozenset()

    sets = [(i, shingles(t)) for i, t in texts]
    comp = list(range(len(sets)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                comp[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for k, (i, _) in enumerate(sets):
        ids.setdefault(top(k), []).append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        members = [j for j in ids[top(k)] if j is not None]
        out.append((i, len(s), min(members) if members else None))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_components(docs, texts, words):
    found = near_dups.near_duplicates(docs, words=words)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == sorted(brute_components(texts, words), key=str)


def test_one_of_each_stays(docs):
    kept = near_dups.dedup(docs, words=2)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 5, 6, 7, 8, 10} <= set(ids) and not {4, 9, 11, 150} & set(ids)


def test_borderline_links_are_found(spark):
    """Pairs just above the threshold, each alone in its region."""
    rows = []
    for k in range(60):
        text = prose(100 + k, 101)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:91] + prose(900 + k, 10)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_dups.near_duplicates(df, words=2)
    assert found.filter("kept").count() == 60


def test_templated_family_is_as_brute_force(spark):
    """Members are 0.77 to 0.79 alike, hardly ever linked; some have one partner just above 0.8."""
    pick, base = random.Random(31), [f"w{k}" for k in range(500)]

    def changed(words, n):
        words = list(words)
        for k in pick.sample(range(len(words)), n):
            words[k] = f"y{pick.randrange(10 ** 9)}"
        return words

    family = [changed(base, pick.randrange(31, 33)) for _ in range(300)]
    family += [changed(x, 54) for x in family[:60]]
    sets = [set(x) for x in family]
    links = [(a, b) for b in range(len(sets)) for a in range(b)
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = list(range(len(sets)))
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(family)],
                               "doc_id bigint, text string")
    found = near_dups.near_duplicates(df, words=1)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == want


def test_regions_cut_by_ranges_are_open(spark):
    """Three nodes of one region, dealt to different ranges: all pairs are found, or the region is open."""
    rows = [(0, bytes(8) + bytes([k] * 8), bytes([k] * 16), 10, bytes(16)) for k in range(3)]
    df = spark.createDataFrame(rows, "tree int, label binary, node binary, n int, bits binary")
    found = near_dups.neighbours(df, 0.8).collect()
    assert sum(r.late < 2 for r in found) == 3 or bytes(9) in {bytes(r.a) for r in found if r.late == 2}


def test_templated_rows_grow_with_the_family(spark):
    """The rows that are sent out to be compared, for families of 300 to 2,400 members hardly ever linked."""
    pick, sent = random.Random(5), {}
    slots = [[f"s{k}v{v}" for v in range(3)] for k in range(40)]
    for m in (300, 2400):
        base = [f"b{k}" for k in range(60)]
        rows = [(k, " ".join(base + [pick.choice(s) for s in slots])) for k in range(m)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        seen = []
        whole = near_dups.remaining

        def counted(rest, sets, threshold):
            dealt = rest.select((F.when(F.col("major"), F.col("minors")).otherwise(
                F.col("minors") + F.col("majors"))).alias("times"))
            seen.append(dealt.agg(F.sum("times")).first()[0])
            return whole(rest, sets, threshold)

        near_dups.remaining = counted
        try:
            near_dups.near_duplicates(df, words=1).count()
        finally:
            near_dups.remaining = whole
        sent[m] = sum(seen)
    assert 0 < sent[2400] < 12 * max(sent[300], 300)


def test_unrelated_texts_without_ids(spark):
    """Null ids: rows are told apart by their whole text; of equal rows and of near copies one stays."""
    copy = " ".join(prose(50, 60))
    near = copy + " end"
    other = " ".join(prose(51, 60))
    rows = [(1, copy), (None, near), (None, other), (None, other), (None, other), (7, copy), (7, near), (8, None),
            (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted(map(repr, (tuple(r) for r in near_dups.dedup(df, words=2).collect())))
    assert left == sorted(map(repr, [(1, copy), (None, other), (8, None), (None, None), (None, "")]))


def test_near_copies_that_share_an_id(spark):
    """Every row has the component's id; still one row of them stays."""
    base = prose(60, 80)
    rows = [(3, " ".join(base + [f"x{k}"])) for k in range(4)] + [(3, " ".join(base + ["x1"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_dups.dedup(df, words=2).count() == 1
    assert {r.component_id for r in near_dups.near_duplicates(df, words=2).collect()} == {3}


def test_words_hashed_together():
    """Texts hashed in one go have the hashes they have alone; words do not run on into the next text."""
    import numpy as np
    import pyarrow as pa

    from countylens.llm import common

    pick = random.Random(8)
    texts = ["", None, " ", "a", "b ", " c d", "é", "x" * 300] + [
        "".join(pick.choice("ab \n\tÀ\u3000") for _ in range(pick.randrange(40))) for _ in range(200)]
    column = pa.array([t.encode() if t is not None else None for t in texts], pa.binary())
    for part in (column, column[5:60], column[0:3]):
        hashes, ends = common.hashed(part)
        want = [common.word_hashes(t) for t in ((x or b"") for x in part.to_pylist())]
        assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert hashes.tolist() == np.concatenate(want).tolist()
        runs = list(common.pieces(part, 30))
        assert [r for a, b in runs for r in range(a, b)] == list(range(len(part)))


def test_keys_of_rows(spark):
    from countylens.llm import common

    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "b"), (0, "a"), (None, None), (None, "")],
                               "doc_id bigint, text string")
    keys = [(r["__i"], r["__t"], r.late) for r in df.select(
        *[x.alias(n) for n, x in common.key_columns("doc_id", "text").items()]).withColumn("late", common.late()).collect()]
    assert len(set(keys)) == 6 and [k[2] for k in keys] == [False, False, True, True, False, True, True]
    assert [k[0] for k in keys[:2]] == [1, 1] and keys[4][0] == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert substrings.digest(empty).count() == 0
    assert near_dups.near_duplicates(empty).count() == 0


def test_chain_is_one_component(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.comp for r in components(links).collect()} == {0}
    assert components(links.filter("false")).count() == 0
