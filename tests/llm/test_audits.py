"""Divergence, filter and SimHash operators against brute force; nulls, ties, repeats, clashing names."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from countylens.llm import divergence, filter_audit, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHES = ("n", "docs", "term", "part", "id", "hash", "fp", "variant", "failed", "TEXT2", "c0", "a.b", "tie")


def wide(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *[F.lit("x").alias(n) for n in CLASHES]).repartition(3)


def whole(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


# ---- divergence


def shares(counts, kept):
    total = sum(counts[t] for t in kept)
    return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}


def brute_divergence(rows, least, top):
    of_group, of_lang, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low))
        of_group[lang, source].update(found)
        of_lang[lang].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, source in of_group:
        kept = [t for t, n in docs[lang].items() if n >= least]
        p, q = shares(of_group[lang, source], kept), shares(of_lang[lang], kept)
        pairs = []
        for other in [s for l, s in of_group if l == lang and s != source]:
            r = shares(of_group[lang, other], kept)
            pairs.append((-sum(abs(p[t] - r[t]) for t in kept), other.encode(), other))
        terms = [(q[t] - p[t], t.encode(), t) for t in kept if of_group[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(terms)[:top])]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    rows = []
    for k in range(240):
        words = [f"{'wW'[pick.randrange(2)]}{chr(97 + pick.randrange(9))}{'é' * pick.randrange(2)}"
                 f"{chr(97 + int(pick.expovariate(.2)) % 26)}" for _ in range(pick.randrange(60))]
        rows.append((k, f"{pick.choice(' ,-@9')}".join(words), pick.choice(["en", "de", None, ""]),
                     pick.choice(["a", "b", "é", "z", None])))
    rows += [(500, None, "en", "only null"), (501, "", "xx", "a"), (502, "one", "xx", "b"), (None, "w x", "en", "a"),
             rows[0], rows[0], (503, " ".join(f"wa{k % 700}" for k in range(40_000)), "en", "long")]
    return rows


@pytest.mark.parametrize("least, top", [(5, 50), (2, 3), (30, 1), (10 ** 6, 5)])
def test_divergence_is_as_brute_force(spark, texts, least, top):
    assert whole(divergence.divergence(wide(spark, texts), least, top)) == brute_divergence(texts, least, top)


def test_divergence_in_blocks(spark, texts, monkeypatch):
    """Few sources and terms to a block, a full table of counts, and rows that must be merged often."""
    for name, value in (("WIDE", 2), ("TERMS", 3), ("HELD", 40), ("BATCH", 8)):
        monkeypatch.setattr(divergence, name, value)
    assert whole(divergence.divergence(wide(spark, texts), 3, 4)) == brute_divergence(texts, 3, 4)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(wide(spark, [])).count() == 0
    none = [(1, None, None, None), (2, None, None, "b")]
    assert whole(divergence.divergence(wide(spark, none))) == brute_divergence(none, 30, 50)


def test_counts_beyond_64_bits(spark):
    """A count times a milliard does not fit in 64 bits."""
    n, total, kept = 3 * 10 ** 12, 10 ** 13, 10 ** 6
    row = spark.createDataFrame([(n, total, kept, 0)], "n bigint, total bigint, kept bigint, none bigint")
    got = row.select(divergence.share("n", "total", "kept"), divergence.share("none", "none", "none")).first()
    assert got[0] == 1 + 10 ** 9 * (n + 5) // (total + 5 * kept) and got[1] is None


@pytest.mark.parametrize("k", [1, 2, 7])
def test_skyband(k):
    pick = random.Random(k)
    points = [(pick.randrange(12), pick.randrange(12), b"%d" % x) for x in pick.sample(range(10 ** 4), 700)]
    group, lang = (np.array([p[j] for p in points]) for j in (0, 1))
    term = np.array([p[2] for p in points], object)
    want = {x for x, (g, l, t) in enumerate(points)
            if sum(a >= g and b <= l and c < t for a, b, c in points) < k}
    assert set(divergence.skyband(group, lang, term, k).tolist()) == want


# ---- filters


def fails(rows):
    out = []
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        out.append((lang or "", i, [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), copy]))
    return out


def brute_audit(rows, good, toxic):
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [(i, f) for p, i, f in fails(rows) if p == part]
        taken = defaultdict(int)
        steps = []
        for order in itertools.permutations(range(5)):
            left = mine
            for step, k in enumerate(order):
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                taken[k] += len(gone)
                steps.append((k, (
                    part, "".join("ABCDE"[j] for j in order), step + 1, len(left), len(gone),
                    sum(f[k] for _, f in mine) - len(gone), sum(f[k] and sum(f) == 1 for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))))
        out += [(*row, taken[k]) for k, row in steps]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def pages():
    pick = random.Random(8)
    rows = []
    for k in range(150):
        size = pick.choice([0, 5, 199, 200, 201, 400])
        words = [pick.choice(["Ab", "cd", "e#", "F", "é"]) + str(pick.randrange(pick.choice([9, 10 ** 6])))
                 for _ in range(size)]
        if pick.random() < .7:
            words = [w.lower().replace("#", "") for w in words]
        rows.append((k, pick.choice([" ", "\t\n", "  "]).join(words), pick.choice(["en", "de", None]), None))
    rows += [(200 + k, rows[k][1], "en", None) for k in range(0, 40, 3)]
    rows += [(300, None, "de", None), (301, "", "de", None), (None, rows[1][1], "en", None), (None, None, None, None),
             rows[5], rows[5], (302, "Long " * 50_000, "", None)]
    return rows


def test_filter_audit_is_as_brute_force(spark, pages):
    marks = [(k, k % 3 == 0, k % 4 == 0) for k in range(0, 320, 2)] + [(0, True, True), (None, True, True)]
    labels = spark.createDataFrame([(k, None if k == 8 else int(q), int(t)) for k, q, t in marks],
                                   "doc_id bigint, quality int, toxic int")
    good = {k for k, q, _ in marks if q and k is not None and k != 8}
    toxic = {k for k, _, t in marks if t and k is not None}
    got = filter_audit.audit(wide(spark, pages), labels)
    assert whole(got) == brute_audit(pages, good, toxic)
    assert got.count() == 600 * 3


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(wide(spark, []), labels).count() == 0
    one = [(1, None, None, None)]
    assert whole(filter_audit.audit(wide(spark, one), labels)) == brute_audit(one, set(), set())


def test_filter_audit_in_many_chunks(spark, pages, monkeypatch):
    monkeypatch.setattr(filter_audit, "CHUNK", 7)
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert whole(filter_audit.audit(wide(spark, pages), labels)) == brute_audit(pages, {2}, set())


def test_galloping_merges():
    pick = random.Random(2)
    for sizes in itertools.product([0, 1, 5, 700, 5000], repeat=2):
        one, two = (np.array(sorted(pick.sample(range(9000), n)), np.int64) for n in sizes)
        assert filter_audit.found(one, two).tolist() == np.isin(one, two).tolist()
        assert filter_audit.less(one, two).tolist() == sorted(set(one) - set(two))
        assert filter_audit.meet(one, two) == len(set(one) & set(two))
        assert filter_audit.union([one, two, one[::2]]).tolist() == sorted({*one, *two})


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + n]).encode(), 42)
              for k in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            top[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(repr((i, f"{prints[k]:016x}", least.get(root(k)))) for k, (i, *_) in enumerate(rows))


@pytest.fixture(scope="module")
def family():
    pick = random.Random(4)
    base = [f"Word{pick.randrange(300)}" for _ in range(300)]
    rows = [(k, " ".join(base[:100 + k % 3] + [f"x{k}"] + base[100:])) for k in range(60)]
    rows += [(100 + k, " ".join(pick.choice(base) for _ in range(pick.randrange(12)))) for k in range(60)]
    rows += [(5, rows[5][1]), (900, None), (901, ""), (902, " \t\n"), (903, "Only two"), (904, "only  TWO"), (905, "one"),
             (None, "one"), (None, None), (None, "nobody else"), (None, "nobody else"), (906, "é É  "),
             (907, " ".join(f"w{pick.randrange(10 ** 6)}" for _ in range(60_000)))]
    return [(i, t, "en", "s") for i, t in rows]


def test_simhash_is_as_brute_force(spark, family):
    got = simhash.near_duplicates(wide(spark, family)).select("doc_id", "fingerprint", "component_id")
    assert whole(got) == brute_classes(family)


def test_fingerprints_at_every_distance(spark):
    """Fingerprints 0 to 4 bits apart, chains among them and bit 63, joined by variants as by brute force."""
    pick = random.Random(6)
    prints = [0, 1, 3, 7, 15, 1 << 63, 3 << 62, 7 << 61, (1 << 64) - 1]
    for _ in range(60):
        seed = pick.getrandbits(64)
        prints += [seed ^ sum(1 << b for b in pick.sample(range(64), n)) for n in (0, 1, 2, 3, 4)]
    signed = sorted({p - (p >> 63 << 64) for p in prints})
    links = simhash.pairs(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and a < b for a, b in links)

    def classes(pairs):
        top = {p: p for p in signed}

        def root(p):
            while top[p] != p:
                p = top[p]
            return p

        for a, b in pairs:
            top[max(root(a), root(b))] = min(root(a), root(b))
        return [root(p) for p in signed]

    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert classes(links) == classes(near)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(wide(spark, [])).count() == 0


def test_spark_has_the_same_hash(spark):
    """Spark's own XXH64 has the seed 42 too, so results can be looked up in SQL."""
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("one two three", 42)
