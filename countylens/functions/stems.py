"""Base forms of English words by stripping suffixes, after Porter's published second algorithm.

A cascade of steps. A step is a list of rules; the first whose ending a word has is the one that counts: where
its condition holds the ending is replaced, else the word stays. Each step is one expression over a
column. ``y`` counts as a vowel but at a word's start or after a vowel, where it is written ``Y``
meanwhile. The first region of a word begins behind the first other letter that follows a vowel, the second
region likewise within the first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
# A syllable after which a short word keeps or gets its e.
SHORT = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"
# What lies in front of a region.
BEFORE_REGION = f"^{OTHER}*{VOWEL}+{OTHER}"


@dataclass(frozen=True)
class Rule:
    """An ending and what it becomes where it lies in the region and what is in front matches ``before``;
    elsewhere ``otherwise``. None: it stays."""

    ending: str
    becomes: str | None = None
    region: int = 0
    before: str = ""
    otherwise: str | None = None


def rules(pairs: str, region: int, before: str = "") -> list[Rule]:
    """Rules written as ``ending>new``."""
    return [Rule(*pair.split(">"), region, before) for pair in pairs.split()]


# Prefixes that are in front of the first region as a whole.
PREFIXES = "gener|commun|arsen"
# Words with forms of their own, and words that are left as they are after the first step.
SPECIAL = dict(pair.split(">") for pair in (
    "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli "
    "singly>singl sky>sky news>news howe>howe atlas>atlas cosmos>cosmos bias>bias andes>andes").split())
STAY = "inning outing canning herring earring proceed exceed succeed".split()
# The rules, the longest endings first.
POSSESSIVE = rules("'s'> 's> '>", 0)
PLURAL = [Rule("sses", "ss"), Rule("ied", "i", before="..", otherwise="ie"),
          Rule("ies", "i", before="..", otherwise="ie"), Rule("us"), Rule("ss"),
          Rule("s", "", before=f"{VOWEL}.")]
PAST = [*rules("eedly>ee", 1), *rules("ingly> edly>", 0, VOWEL), *rules("eed>ee", 1), *rules("ing> ed>", 0, VOWEL)]
LAST_Y = rules("y>i Y>i", 0, f".{OTHER}$")
LONG = [*rules("ization>ize ational>ate fulness>ful ousness>ous iveness>ive tional>tion biliti>ble lessli>less "
               "entli>ent ation>ate alism>al aliti>al ousli>ous iviti>ive fulli>ful enci>ence anci>ance "
               "abli>able izer>ize ator>ate alli>al bli>ble", 1),
        *rules("ogi>og", 1, "l$"), *rules("li>", 1, "[cdeghkmnrt]$")]
MIDDLE = [*rules("ational>ate tional>tion alize>al icate>ic iciti>ic", 1), *rules("ative>", 2),
          *rules("ical>ic ness> ful>", 1)]
SHORTER = [*rules("ement> ance> ence> able> ible> ment> ant> ent> ism> ate> iti> ous> ive> ize>", 2),
           *rules("ion>", 2, "[st]$"), *rules("al> er> ic>", 2)]
LAST_L = Rule("l", "", 2, "l$")
DOUBLES = "bb dd ff gg mm nn pp rr tt".split()


def with_stems(words: DataFrame, word: str = "word", name: str = "base") -> DataFrame:
    """The words with a further column, their base form. Words are lower-case; null and short ones stay."""
    w, size = F.col("_w"), F.length("_w")
    marked = F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), f"({VOWEL})y", "$1Y")
    rows = stripped(words.withColumns({"_w": marked, "_stays": F.lit(False)}), POSSESSIVE)
    front = F.length(F.regexp_extract("_w", f"^({PREFIXES})|{BEFORE_REGION}", 0))
    rows = rows.withColumn("_f", front).withColumn("_r1", F.when(F.col("_f") > 0, F.col("_f")).otherwise(size))
    rest = F.length(F.regexp_extract(F.substring(w, F.col("_r1") + 1, size), BEFORE_REGION, 0))
    rows = rows.withColumn("_f", rest).withColumn(
        "_r2", F.when(F.col("_f") > 0, F.col("_r1") + F.col("_f")).otherwise(size))
    rows = stripped(rows, PLURAL).withColumn("_stays", w.isin(STAY))
    rows = stripped(rows.withColumn("_was", w), PAST)
    past = (F.length("_was") - size > 1) & ~F.col("_was").rlike("eed(ly)?$")
    rows = rows.withColumn("_w", F.when(past, mended(w)).otherwise(w))
    for step in (LAST_Y, LONG, MIDDLE, SHORTER):
        rows = stripped(rows, step)
    rows = rows.withColumn("_stem", F.left(w, size - 1))
    silent = (size - 1 >= F.col("_r2")) | ((size - 1 >= F.col("_r1")) & ~F.col("_stem").rlike(SHORT))
    rows = rows.withColumn("_e", ~F.col("_stays") & w.endswith("e")).withColumn(
        "_w", F.when(F.col("_e") & silent, F.col("_stem")).otherwise(w)).withColumn(
        "_stays", F.col("_stays") | F.col("_e"))
    rows = stripped(rows, [LAST_L])
    special = F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair])
    base = F.when(F.length(word) <= 2, F.col(word)).otherwise(
        F.coalesce(F.try_element_at(special, F.col(word)), F.translate(w, "Y", "y")))
    return rows.select(*words.columns, base.alias(name))


def stripped(rows: DataFrame, step: Sequence[Rule]) -> DataFrame:
    """One step of the cascade on ``_w``, but where ``_stays``. The longest ending is the leftmost match."""
    ending, stem = F.col("_e"), F.col("_stem")
    rows = rows.withColumn("_e", F.regexp_extract("_w", f"({'|'.join(r.ending for r in step)})$", 1)).withColumn(
        "_stem", F.left("_w", F.length("_w") - F.length(ending)))
    alike = defaultdict(list)
    for r in step:
        if r.becomes is not None:
            alike[r.region, r.before].append(r.ending)
    holds = []
    for (region, before), endings in alike.items():
        tests = [ending.isin(endings)] + ([F.length(stem) >= F.col(f"_r{region}")] if region else [])
        holds.append(reduce(Column.__and__, tests + ([stem.rlike(before)] if before else [])))
    becomes = F.create_map(*[F.lit(x) for r in step if r.becomes is not None for x in (r.ending, r.becomes)])
    new = F.when(F.col("_stays"), F.col("_w")).when(
        reduce(Column.__or__, holds), F.concat(stem, F.try_element_at(becomes, ending)))
    for r in step:
        if r.otherwise is not None:
            new = new.when(ending == r.ending, F.concat(stem, F.lit(r.otherwise)))
    return rows.withColumn("_w", new.otherwise(F.col("_w")))


def mended(w: Column) -> Column:
    """What is left of a past or an ing form, with its e or without its doubled letter."""
    short = (F.length(w) <= F.col("_r1")) & w.rlike(SHORT)
    return (F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(w.rlike(f"({'|'.join(DOUBLES)})$"), F.left(w, F.length(w) - 1))
            .when(short, F.concat(w, F.lit("e"))).otherwise(w))
