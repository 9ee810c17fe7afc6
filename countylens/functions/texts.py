"""Expressions that clean short texts and cut them into words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# What makes a link, and which words are too common in these texts to count.
URL = r"https?://.*?\.(com|org|net|edu|gov)"
LINK_WORDS = ("rt", "http", "https")
TOPIC_WORDS = ("corona", "covid")
SHORT_LINK = "//t.co"
CUT_OFF = "..."
MIN_LETTERS = 4

# Word-splitting rules in the order they apply to lower-cased text: (pattern, replacement). No
# look-around, so that any SQL engine with RE2-style patterns can run the same rules.
SPLIT_RULES = (
    # runs of dots, dashes, single marks and white space other than blanks stand alone
    (r"(\.{2,}|--|[\t\n\x0b\f\r;@#$%&?!*()\[\]{}<>\"“”‘’«»„`])", r" \1 "),
    # a last dot leaves its word; colon and comma do unless a digit follows
    (r"([^. ])(\.)('*)(\s|$)|([:,])([^0-9]|$)", r"\1 \2\5 \3\4\6"),
    # contractions are cut in two
    (r"([^' ])('s|'m|'d|'ll|'re|'ve|n't|')(\s|$)", r"\1 \2\3"),
    (r"\b(?:(can)(not)|(gon|wan)(na)|(got)(ta)|(gim|lem)(me))\b", r"\1\3\5\7 \2\4\6\8"),
    (r"\b(?:(d)('ye)|(more)('n))\b", r"\1\3 \2\4"),
    (r"(^|\s)('t)(is|was)\b", r"\1\2 \3"),
)
ALWAYS, CONTRACTIONS = SPLIT_RULES[:2], SPLIT_RULES[2:]
# Only texts with one of these have contractions.
IN_CONTRACTIONS = ("'", "cannot", "gonna", "wanna", "gotta", "gimme", "lemme")
NO_WORDS = ("", "\t", "\n", "\x0b", "\f", "\r")

# A word of letters and digits with at most one mark behind it, and the starts of words that the
# last rule may cut in two.
PLAIN = r"^[\p{L}\p{N}]+[.,:;?!]?\z"
LAST_MARKS = (".", ",", ":", ";", "?", "!")
TWO_WORD_STARTS = ("canno", "gonna", "wanna", "gotta", "gimme", "lemme")

# Runs of letters, underscores and letter-like numbers; digits and marks end a run.
LETTER_RUN = r"([\p{L}\p{Nl}\p{No}_]+)"


def strip_urls(text: Column) -> Column:
    """Each link up to its top-level domain becomes a blank.

    The shortest match may run from a short link to a later domain on the same line; that is
    part of the rule. ``(?d)`` lets ``.`` match everything but a newline.
    """
    return F.when(F.contains(text, F.lit("http")),
                  F.regexp_replace(text, "(?d)" + URL, " ")).otherwise(text)


def one_line(text: Column) -> Column:
    """Line breaks are deleted, with no blank in their place."""
    return F.translate(text, "\n\r", "")


def chunks(text: Column) -> Column:
    """The lower-cased text without links, cut at blanks, as an array."""
    return F.split(F.lower(strip_urls(text)), " ")


def pieces(chunk: Column) -> Column:
    """The words and marks of one chunk, as an array that may hold ``NO_WORDS``.

    Rules look no further than the next white space, so a chunk can be cut by itself. Nearly all
    chunks are a plain word, with a mark behind it or not, and need no rule.
    """
    plain = chunk.rlike(PLAIN) & ~F.substring(chunk, 1, 5).isin(*TWO_WORD_STARTS)
    return (F.when(plain & F.right(chunk, F.lit(1)).isin(*LAST_MARKS),
                   F.array(F.left(chunk, F.length(chunk) - 1), F.right(chunk, F.lit(1))))
            .when(plain, F.array(chunk))
            .otherwise(F.split(_spaced(chunk), " ")))


def tokens(text: Column) -> Column:
    """Lower-cased words and punctuation of a text, contractions split off, as an array."""
    return F.filter(F.flatten(F.transform(chunks(text), pieces)), lambda t: ~t.isin(*NO_WORDS))


def _spaced(chunk: Column) -> Column:
    marked = _apply(chunk, ALWAYS)
    contracted = F.lit(False)
    for sign in IN_CONTRACTIONS:
        contracted |= F.contains(chunk, F.lit(sign))
    return F.when(contracted, _apply(marked, CONTRACTIONS)).otherwise(marked)


def _apply(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement.replace("\\", "$"))
    return text


def is_counted_word(word: Column, stopwords: Iterable[str] = ()) -> Column:
    """Words that say something: long enough, no link rests, no cut-off, not the topic itself."""
    keep = (F.length(word) >= MIN_LETTERS) & ~word.isin(*LINK_WORDS)
    keep &= ~F.startswith(word, F.lit(SHORT_LINK)) & ~F.endswith(word, F.lit(CUT_OFF))
    for topic in TOPIC_WORDS:
        keep &= ~F.contains(word, F.lit(topic))
    stopwords = list(stopwords)
    return keep & ~word.isin(*stopwords) if stopwords else keep


def letter_runs(text: Column) -> Column:
    """Lower-cased runs of letters of a text, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTER_RUN), F.lit(1))


def is_letter_token(run: Column, shortest: int = 2, longest: int = 15) -> Column:
    return F.length(run).between(shortest, longest) & ~F.startswith(run, F.lit("_"))


def letter_tokens(text: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Letter runs of bounded length, for topic models, as an array."""
    return F.filter(letter_runs(text), lambda t: is_letter_token(t, shortest, longest))


def is_topic_word(word: Column, stopwords: Iterable[str] = ()) -> Column:
    stopwords = list(stopwords)
    keep = is_letter_token(word) & (F.length(word) >= MIN_LETTERS)
    return keep & ~word.isin(*stopwords) if stopwords else keep
