import pytest
from pyspark.sql import functions as F

from countylens.catalog import STOPWORDS
from countylens.functions import texts


@pytest.fixture(scope="module")
def cut(one):
    return lambda text: one(texts.tokens(F.lit(text)))


def kept(words):
    return lambda one: [w for w in words if one(texts.is_counted_word(F.lit(w), STOPWORDS))]


@pytest.mark.parametrize("text,want", [
    ("look https://a.com/x now", "look  /x now"),
    ("HTTPS://A.COM stays", "HTTPS://A.COM stays"),
    ("at https://t.co/Ab then b.org end", "at   end"),
    ("https://t.co/Ab only", "https://t.co/Ab only"),
    ("https://t.co/Ab\nthen b.org", "https://t.co/Ab\nthen b.org"),
    ("https://t.co/Ab\rthen b.org", " "),
])
def test_strip_urls(one, text, want):
    assert one(texts.strip_urls(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ("", []),
    ("Stay home.", ["stay", "home", "."]),
    ("a.b. Then", ["a.b", ".", "then"]),
    ("don't can't people's we'll", ["do", "n't", "ca", "n't", "people", "'s", "we", "'ll"]),
    ("don’t", ["don", "’", "t"]),
    ("#Covid19, really?!", ["#", "covid19", ",", "really", "?", "!"]),
    ("at 10:30, 1,000 rt: x", ["at", "10:30", ",", "1,000", "rt", ":", "x"]),
    ("wait... what", ["wait", "...", "what"]),
    ("end..", ["end", ".."]),
    ("well--known", ["well", "--", "known"]),
    ("cannot gonna gotta wanna gimme lemme",
     ["can", "not", "gon", "na", "got", "ta", "wan", "na", "gim", "me", "lem", "me"]),
    ("HTTPS://T.CO/x", ["https", ":", "//t.co/x"]),
    ('say "hi" (now) [x]', ["say", '"', "hi", '"', "(", "now", ")", "[", "x", "]"]),
    ("the dogs' bowl", ["the", "dogs", "'", "bowl"]),
    ("tabs\tand\nlines", ["tabs", "and", "lines"]),
])
def test_tokens(cut, text, want):
    assert cut(text) == want


def test_apostrophes_stay_in_words(cut):
    assert cut("o'brien rock'n'roll") == ["o'brien", "rock'n'roll"]


def test_counted_words(one):
    words = ["the", "then", "home", "rt", "http", "https", "//t.co/x", "....", "word...",
             "coronavirus", "mycovid", "abc", "work", "should've", "a...b"]
    assert kept(words)(one) == ["home", "work", "a...b"]


def test_null_text(one):
    assert one(texts.tokens(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("text,want", [
    ("Covid19 cases", ["covid", "cases"]),
    ("a bb " + "c" * 15 + " " + "d" * 16, ["bb", "c" * 15]),
    ("_x x_y días", ["x_y", "días"]),
    ("don't", ["don"]),
])
def test_letter_tokens(one, text, want):
    assert one(texts.letter_tokens(F.lit(text))) == want


def test_one_line(one):
    assert one(texts.one_line(F.lit("a\nb\r\nc"))) == "abc"


def test_rules_may_be_applied_chunk_by_chunk(spark):
    """The chunk-wise words are those of the rules applied to whole texts in another engine."""
    import duckdb

    from checks.tables import tokens_sql
    parts = ["it's", "don't.", "cannot,", "gonna", "(well)", "a.b.", "wait...", "x--y", "10:30", "é",
             "1,000", "“so”", "'tis", "dogs'", "a,:b", ". .", "\t", "\n", "rock'n'roll", "why?!", "",
             "gotta's", "u.s.", "http", "...", "'", ".'", "word", "Word:", "lemmex", "x_y", "a'"]
    texts_ = [" ".join((a, b, c)) for i, a in enumerate(parts) for b in parts
              for c in parts[i % 7::7]]
    df = spark.createDataFrame([(t,) for t in texts_], "text string")
    got = {r.text: r.t for r in df.select("text", texts.tokens(F.col("text")).alias("t")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE given(text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?)", [(t,) for t in texts_])
    for text, want in con.execute(f"SELECT text, {tokens_sql('text')} FROM given").fetchall():
        assert got[text] == want, text


@pytest.mark.parametrize("text,want", [
    ("'tis so", ["'t", "is", "so"]), ("'Twas late", ["'t", "was", "late"]),
    ("D'ye know", ["d", "'ye", "know"]), ("more'n one", ["more", "'n", "one"]),
    ("cannot gonna", ["can", "not", "gon", "na"]), ("don't we'll", ["do", "n't", "we", "'ll"]),
    ("wait.... end.", ["wait", "....", "end", "."]), ("at 10:30, yes", ["at", "10:30", ",", "yes"])])
def test_fixed_tokens(one, text, want):
    assert one(texts.tokens(F.lit(text))) == want
