"""Registered queries of the operators: each takes the whole table it is meant for.

SQL is given where it can state the result; the other queries are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from countylens.llm import (
    chat, divergence, filter_audit, fingerprints, language, lexicon, mixing, near_dups, quality, simhash,
    substrings, token_counts, toxicity,
)
from countylens.llm.common import small_batches

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix(_table(spark, folder, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "copies", (
        F.col("size") * F.col("copies")).alias("taken"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), VOCABULARY)


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_next(_table(spark, folder, "documents"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    learned = language.learn(docs.filter(F.coalesce(~held_out, F.lit(False))), key=F.col("doc_id"))
    found = language.predicted(docs, learned)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred",
                        "score", "accepted")


def op6_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.near_duplicates(_table(spark, folder, "documents"), words=2, threshold=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(told).alias("text"))
    talks = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(talks.unionByName(extra))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    return toxicity.graded(docs, model)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents")).select(
        "doc_id", *quality.BASE, "base_failed", "kept")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.encoded(_table(spark, folder, "documents"), VOCABULARY, digests=True)


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(_table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents")).select(
        "doc_id", "fingerprint", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix, op2_token_counts, op3_fingerprints, op4_substring_dedup, op5_language_id,
        op6_near_dups, op7_chat, op8_toxicity, op9_quality, op10_bpe, op11_source_divergence,
        op12_filter_audit, op13_simhash)
} | {"pipeline": corpus_pipeline.run}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SQL: dict[str, str] = {
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
p AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS run
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM p QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM later),
cut AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(len(ats), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ats IS NULL THEN words ELSE
    list_filter(words, lambda x, i: NOT list_contains(ats, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)""",
    "op6_near_dups": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
        ELSE list_distinct(list_transform(range(1, len(words)),
             lambda i: words[i] || ' ' || words[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (g)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
      WHERE 100 * m >= 80 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS r FROM documents
      UNION SELECT r.doc_id, edge.b FROM r JOIN edge ON r.r = edge.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.r) AS component_id,
  d.doc_id = min(r.r) AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n""",
    "op7_chat": """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
  sum(9 + length(role) + length(text) + length(regexp_replace(text, '[^\\\\<\\[\\]]', '', 'g'))
      + length(regexp_replace(role, '[^\\\\<\\[\\]]', '', 'g'))) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM x""",
    "op11_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v,
    (SELECT coalesce(sum(n), 0) FROM kept k WHERE k.lang = g.lang) AS total FROM (SELECT DISTINCT lang FROM d) g),
cells AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT g.lang, g.source, v, langs.total AS lang_total, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) g JOIN langs USING (lang)
    LEFT JOIN cells c USING (lang, source) GROUP BY ALL),
share AS (SELECT grp.lang, grp.source, kept.term, coalesce(cells.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(cells.n, 0) + 5)) // (grp.total + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 5)) // (lang_total + 5 * v) AS q
    FROM grp JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM share a JOIN share b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 50""",
    "op12_filter_audit": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT r, part,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) IS TRUE AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) IS TRUE AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
l AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(c)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS f,
    list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
kinds AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS hit,
    step > 1 AND len(list_filter(before, lambda b: fails[b])) > 0 AS gone,
    len(list_filter(fails, lambda y: y)) = 1 AND fails[f] AS only_this FROM kinds, steps),
y AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (only_this), 0) AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y""",
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
