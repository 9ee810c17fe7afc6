"""Encoding, counts, fingerprints, language, severity and quality against libraries and brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from countylens.llm import common, fingerprints, language, lexicon, quality, token_counts, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("word_bpe_49k.json")
ODD = [None, "", " \n", "Étion á <|endoftext|>x İI ab<|startoftext|> ΑΣ ΣΑ ½ ² Ⅷ ٣", "x y\x1cz\x85",
       "I'M we'll don’t 日本語テキスト 😀👍🏽 é \x00", "a" * 3000, "hello hello world", "hello hello world"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(k, t, "x", 1) for k, t in enumerate(ODD)] + [(None, "no id", "x", 1)],
        "doc_id bigint, text string, ids string, n_tokens int").repartition(2)


def test_encodes_as_the_library_does(docs):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    rows = {r.doc_id: r for r in lexicon.encoded(docs, VOCABULARY, most=3, digests=True).collect()}
    plain = {r.doc_id: r.ids for r in lexicon.encoded(docs, VOCABULARY).collect()}
    assert len(rows) == len(ODD) + 1
    for k, text in enumerate(ODD):
        want = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(want, skip_special_tokens=False)
        assert plain[k] == want
        assert rows[k].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_round_trip(spark, docs):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    back = lexicon.decoded(lexicon.encoded(docs, VOCABULARY), VOCABULARY)
    for r in back.collect():
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_automaton_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(
        ["walking", "talking", "talk", "walk", "king", "é", "éa", "walked", "talked"])}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(lexicon.Lexicon.build(words).written())
    held = lexicon.Lexicon.load(str(path))
    asked = [*words, b"wal", b"walks", b"", b"zzz", b"talkin"]
    found = held.find(asked)
    assert all(held.output(int(p)) == words[w] for w, p in zip(asked, found) if w in words)
    assert (found[len(words):] == -1).all() and sorted(found[:len(words)]) == list(range(len(words)))
    assert len(held.accepts) < sum(map(len, words)) - 8  # suffixes are shared
    assert lexicon.Lexicon.build({}).find([b"a"]).tolist() == [-1]


def test_most_frequent(spark):
    """Far above any count of the given tables the bound holds as well."""
    rows = [(g, k, scale * (k + 1)) for g, scale in (("a", 1), ("b", 10 ** 9)) for k in range(100)]
    counts = spark.createDataFrame(rows + [("c", k, 7) for k in range(50)], "g string, k int, n bigint")
    got = {}
    for r in common.most_frequent(counts, 30, "g").collect():
        got.setdefault(r.g, []).append(r.k)
    assert set(got) == {"a", "b"} and all(
        28 <= len(ks) <= 30 and sorted(ks) == list(range(100 - len(ks), 100)) for ks in got.values())
    assert common.most_frequent(counts.filter("false"), 30, "g").count() == 0


def test_long_and_short_words_merge_alike():
    own, pick = lexicon.Vocabulary(VOCABULARY), random.Random(12)
    words = ["".join(pick.choices("etaoinshrdé日a", k=pick.randrange(1, 40))) for _ in range(2000)]
    for raw in [w.encode()[:lexicon.SHORT] for w in words] + [b"a" * 64, b"ab" * 32]:
        assert own._merge_short(raw) == own._merge_long(raw)


def test_ascii_is_cut_alike():
    pick = random.Random(13)
    for _ in range(3000):
        text = "".join(pick.choices("aZ'stdvelm019 !-\t\n\x00\x1c\x1f\x7f", k=30))
        assert lexicon.prepared(text) == lexicon.PIECES.findall(text.lower())


def test_counts_are_greedy(docs):
    own = lexicon.Vocabulary(VOCABULARY)

    def greedy(word):
        if word in own.specials:
            return 1
        s, i, n = [own.letters[b] for b in word.encode()], 0, 0
        while i < len(s):
            i = next(j for j in range(len(s), i, -1) if "".join(s[i:j]) + (
                lexicon.END if j == len(s) else "") in own.ids)
            n += 1
        return n

    for r in token_counts.token_counts(docs, VOCABULARY).filter("doc_id is not null").collect():
        words = lexicon.pieces(ODD[r.doc_id], own)
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(greedy, words)))


def test_links_skip_no_letter():
    """A vocabulary in which the greedy choice has to be given up after several letters."""
    held = lexicon.Vocabulary(VOCABULARY)
    held.ids = {x: k for k, x in enumerate(["a", "b", "c", "abcab", "bc", "a</w>", "b</w>", "c</w>"])}
    match = token_counts.LongestMatch(held)
    assert match.counts([b"abcaa", b"abcabc", b"abcab", b"x", b"abx", b""]).tolist() == [
        4, 2, 4, -1, -1, 0]


def shingles(text):
    raw = text.encode()
    return {raw[k:k + 16] for k in range(max(1, len(raw) - 15))} if raw else set()


def test_fingerprints(spark):
    pick = random.Random(5)
    texts = {k: " ".join(f"w{pick.randrange(900)}" for _ in range(n)) for k, n in enumerate(
        [0, 1, 3, 40, 200, 900, 4000])}
    texts[7] = texts[5]
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in fingerprints.with_next(frame).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        follow = texts[order[(k + 1) % len(order)]]
        new = texts[i][:len(texts[i]) - len(texts[i]) // 2] + follow[:len(texts[i]) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert rows[i].n_chars == len(texts[i])
        a, b = shingles(texts[i]), shingles(new)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(rows[i].near_edited - true) < 0.25
    assert rows[7].fingerprint == rows[5].fingerprint
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame).collect()}
    assert plain == {i: r.fingerprint for i, r in rows.items()}


def test_sketches_unite():
    pick = random.Random(6)
    a, b = (" ".join(f"w{pick.randrange(9000)}" for _ in range(n)) for n in (3000, 200))
    x, y = fingerprints.sketch(a), fingerprints.sketch(b)
    both = fingerprints.united(x, y)
    assert fingerprints.read(fingerprints.written(*x))[1].tolist() == x[1].tolist()
    assert set(both[1]) == {h for h in {*x[1], *y[1]} if h < both[0]}
    assert fingerprints.containment(y, both) == 1.0 and fingerprints.likeness(x, x) == 1.0
    assert fingerprints.sketch(a + b)[1].size <= x[1].size + y[1].size + 32


def test_next_of_one_and_of_null_ids(spark):
    one = fingerprints.with_next(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string"))
    assert one.first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = spark.createDataFrame([(None, None), (None, "x"), (2, "ab")], "doc_id bigint, text string")
    assert fingerprints.with_next(rows).count() == 3
    assert fingerprints.with_next(rows.filter("false")).count() == 0


SYLLABLES = {"en": ["th", "er", "ing", "on", "at"], "fr": ["eau", "é", "que", "ou", "le"],
             "de": ["sch", "ung", "ei", "ß", "en"]}


@pytest.fixture(scope="module")
def spoken(spark):
    pick = random.Random(7)
    rows = []
    for k in range(150):
        lang = pick.choice(list(SYLLABLES))
        text = " ".join("".join(pick.choices(SYLLABLES[lang], k=3)) for _ in range(pick.randrange(3, 60)))
        rows.append((k, text, lang))
    rows += [(200, None, "en"), (201, "12 %", "fr"), (202, "the", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages(spoken):
    learned = language.learn(spoken.filter("doc_id % 3 <> 1"), key=F.col("doc_id"))
    rows = language.predicted(spoken, learned, keep=("lang",)).collect()
    assert len(rows) == 153
    held = [r for r in rows if r.doc_id % 3 == 1 and r.doc_id < 200]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in rows if r.doc_id >= 200}
    assert [odd[k].lang_pred for k in (200, 201)] == ["und", "und"] and odd[202].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in rows)


def kneser_ney(texts, order, known):
    """P(last character of a run of any length up to the order), as the formulas say."""
    from collections import Counter

    of = {order: Counter(t[k:k + order] for t in texts for k in range(len(t) - order + 1))}
    for k in range(order, 1, -1):
        of[k - 1] = Counter(g[1:] for g in of[k])
    d = language.DISCOUNT

    def p(run):
        if not run:
            return 1 / (known + 1)
        after = [n for g, n in of[len(run)].items() if g[:-1] == run[:-1]]
        if not after:
            return p(run[1:])
        return max(of[len(run)][run] - d, 0) / sum(after) + d * len(after) / sum(after) * p(run[1:])

    return p


def test_probabilities_as_the_formulas_say(spoken):
    rows = [(r.lang, language.letters(r.text)) for r in spoken.collect() if r.lang]
    model, *_ = language.learn(spoken, key=F.col("doc_id"), least=0.0)
    texts = {lang: [t for name, t in rows if name == lang and len(t) >= 4] for lang in model.langs}
    known = len({ch for many in texts.values() for t in many for ch in t[3:]} | {
        ch for many in texts.values() for t in many for ch in t})
    pick = random.Random(5)
    some = pick.sample(sorted({t[k:k + 4] for many in texts.values() for t in many for k in range(len(t) - 3)}), 40)
    for lang, many in texts.items():
        p = kneser_ney(many, 4, model.known)
        for run in some + ["zzqx", "th字", "字字字字", "e th"[:4]]:
            run = run[:4].rjust(4)
            assert 2.0 ** -model.entropy(language.codes(run))[model.langs.index(lang)] == pytest.approx(
                p(run), rel=1e-3), (lang, run)
    assert model.known <= known


@pytest.mark.parametrize("least", [0.0, 1e-4, 1e-2])
def test_probabilities_add_up(spoken, least):
    """After any context the characters met, and the one share of all others, make 1, whatever is left out."""
    model, *_ = language.learn(spoken, key=F.col("doc_id"), least=least)
    every = sorted({ch for r in spoken.collect() if r.lang for ch in language.letters(r.text)})
    every = [ch for ch in every if language._of_rows(language.codes(ch).reshape(1, 1))[0] in model.hashes[0]]
    assert len(every) == model.known
    for context in ("th ", " sc", "eau", "xqx"):
        total = sum(2.0 ** -model.entropy(language.codes(context + ch)) for ch in every)
        assert np.allclose(total + 2.0 ** -model.entropy(language.codes(context + "字")), 1, atol=1e-3)


def test_learns_from_the_rows_of_calibration(spark):
    """A language whose few documents all fall into the set aside is known."""
    rows = [(k, "the cat sat on the mat %s" % chr(97 + k % 26), "en") for k in range(60)]
    aside = [r.id for r in spark.range(1000, 1400).filter(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).collect()][:2]
    rows += [(k, "κάτι εντελώς άλλο εδώ", "el") for k in aside]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model, *_ = language.learn(docs, key=F.col("doc_id"))
    assert model.langs == ["el", "en"]
    one = spark.createDataFrame([(1, "κάτι άλλο")], "doc_id bigint, text string")
    assert language.predicted(one, language.learn(docs, key=F.col("doc_id"))).first().lang_pred == "el"


def test_nothing_learned(spoken):
    assert language.learn(spoken.filter("false")) is None
    rows = language.predicted(spoken.limit(3), None).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_severity(spark):
    pick = random.Random(8)
    rows, labels = [], []
    for k in range(300):
        words = [f"word{chr(97 + pick.randrange(26))}{chr(97 + pick.randrange(26))}" for _ in range(40)]
        bad = k % 4 == 0
        for _ in range(pick.randrange(1, 7) if bad else 0):
            words[pick.randrange(40)] = pick.choice(["scum", "moron", "idiot"])
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(bad)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "scum moron", "s"), (None, "worda", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, severity string")
    known = spark.createDataFrame(labels + [(5000, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.graded(docs, model).collect()}
    assert all(got[k].toxic == bool(bad) for k, bad in labels)
    assert not got[900].toxic and not got[901].toxic and got[902].toxic
    assert all(abs(r.severity) <= toxicity.GRADES for r in got.values())
    kept = toxicity.clean(docs, known)
    assert kept.columns == docs.columns and kept.count() == 300 - 75 + 3
    assert toxicity.fit(docs, known.filter("toxic = 0")) is None


def test_base_statistics():
    text = "a b c\na b c\n\n#x $ \xa0é\n \na b"
    assert quality.base_statistics(text) == (11, 13, 2, 1, 6)
    assert quality.base_statistics(None) == quality.base_statistics("") == (0, 0, 0, 0, 0)


def test_outliers(spark):
    pick = random.Random(9)
    rows = []
    for k in range(400):
        n = pick.randrange(60, 200)
        words = [f"w{pick.randrange(10 ** 6)}" for _ in range(n)]
        if k % 40 == 0:
            words = [w + "%%%&&&" for w in words]
        rows.append((k, " ".join(words), "en", f"s{k % 3}"))
    rows += [(500, None, "en", "s0"), (501, "short", None, None), (502, " ".join(["a"] * 80), "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert len(got) == 403
    assert all(got[k].kept == (k % 40 != 0) for k in range(400))
    assert all(got[k].base_failed and not got[k].kept for k in (500, 501, 502))
    few = quality.judged(docs.limit(5)).collect()  # five are judged as many are, by the floors
    assert sorted(r.doc_id for r in few if r.kept) == [1, 2, 3, 4]
    assert quality.judged(docs.filter("false")).count() == 0


def vectors(spark, groups):
    return spark.createDataFrame(
        [(g, k % quality.LOTS, *map(float, v)) for g, rows in groups.items() for k, v in enumerate(rows)],
        "g string, lot int, " + ", ".join(f"{n} double" for n in quality.NAMES))


def test_chi_squared():
    assert quality.chi_squared(0.5, 7) == pytest.approx(6.346, abs=0.02)
    assert quality.chi_squared(0.999, 7) == pytest.approx(24.32, rel=0.01)  # the cube root is that near
    draws = np.random.default_rng(1).normal(size=(200_000, 7))
    d = (draws ** 2).sum(axis=1)
    near = draws[d <= np.quantile(d, quality.H)]
    assert quality.consistency(quality.H, 7) == pytest.approx(1 / near.var(axis=0).mean(), rel=0.02)


def test_least_determinant_by_brute_force(spark):
    """Of all shares of small groups, the estimate takes the one of least determinant, or one hardly larger."""
    from itertools import combinations

    pick = np.random.default_rng(4)
    groups = {}
    for k in range(6):
        rows = pick.normal(size=(14, quality.P))
        rows[:2] += pick.normal(size=quality.P) * 30  # two far ones
        groups[f"g{k}"] = rows
    found = {r.g: r for r in quality.covariance_estimates(vectors(spark, groups)).collect()}

    def size(rows):
        return np.linalg.slogdet(np.cov(rows.T, bias=True) + quality.FLOOR)[1]

    for g, rows in groups.items():
        got = found[g]
        least = min(size(rows[list(some)]) for some in combinations(range(14), 11))
        own = np.linalg.slogdet(quality.square(got.spread) + quality.FLOOR)[1]
        assert got.n == 11 and least - 1e-9 <= own <= least + 1.0
        # A step more changes nothing: the estimate is that of the documents nearest to it.
        off = rows - np.array(got.mean)
        far = np.einsum("ij,jk,ik->i", off, np.linalg.inv(quality.square(got.spread) + quality.FLOOR), off)
        kept = rows[np.argsort(far)[:11]]
        assert np.allclose(kept.mean(axis=0), got.mean) and not {0, 1} & set(np.argsort(far)[:11])


def test_no_switch_by_size(spark):
    """One document more or less moves distances by little, at any size of a group."""
    pick = random.Random(2)
    rows = [(k, " ".join(f"w{pick.randrange(10 ** 6)}" for _ in range(pick.randrange(60, 200))), "en", s)
            for s, n in (("a", 201), ("b", 4)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    some = [{(r.source, r.doc_id): r.distance for r in quality.judged(docs.filter(f"doc_id < {n}")).collect()}
            for n in (199, 200, 201)]
    for key, d in some[0].items():
        assert some[1][key] == pytest.approx(d, rel=0.25, abs=0.3)
        assert some[2][key] == pytest.approx(d, rel=0.25, abs=0.3)
