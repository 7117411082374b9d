"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import (
    chat, fingerprints, html_text, langid, mixing, near_dup, packing, quality, quality_model, ranking, sharding, spelling, tokens,
)
from shelfwise.llm.common import table


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.length_histogram(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("failed_rules")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("rate")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_length_histogram, op2_language_id, op3_chat_formatting, op4_best_fit_packing, op5_quality_rules,
        op6_source_mixing, op7_html_extraction, op8_document_fingerprints, op9_minhash_near_dedup, op10_sharding,
        op11_ranked_search, op12_spelling_variants, op13_quality_classifier,
    )
}

_CHAT = """
WITH logged AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST) AS turns, count(*) AS n
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), whole AS (
  SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM logged GROUP BY turns, n
), heads AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM whole)
)
SELECT conv_id, n AS n_turns, n_copies,
  array_to_string(list_transform(turns, lambda x: concat('<|im_start|>', replace(coalesce(x.r, ''), '<|', '< |'), chr(10),
    replace(coalesce(x.t, ''), '<|', '< |'), '<|im_end|>', chr(10))), '') AS rendered
FROM whole WHERE turns NOT IN (SELECT turns FROM heads)
"""

_STOPS = ", ".join(f"'{f(w)}'" for w in sorted(set(quality.STOP_WORDS.split())) for f in (str.lower, str.capitalize, str.upper))

_QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), positions AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT rid, i FROM positions QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop_words
  FROM w LEFT JOIN covered USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(n_stop_words AS BIGINT) AS n_stop_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= 50 AND 2 * n_repeat_words <= n_words AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words
    AND n_symbols / n_words <= 0.3 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.3) AND n_stop_words / n_words >= 0.01 AS kept
FROM m
"""

_MIXING = """
WITH sources AS (
  SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS volume FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN volume > 0 THEN sqrt(volume) / (SELECT sum(sqrt(volume)) FROM sources) * (SELECT sum(volume) FROM sources) / volume ELSE 1 END AS rate
  FROM sources
), steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM (SELECT source, rate, unnest(range(0, CAST(rate + 12 * sqrt(rate) + 31 AS BIGINT))) AS k FROM rates)
), drawn AS (
  SELECT doc_id, text, lang, source, n_chars,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT d.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.below <= d.u) AS n FROM drawn d
), replicas AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, n)) AS INTEGER) AS copy FROM counted
)
SELECT *, md5('18:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) || ':' || copy) AS shuffle_key FROM replicas
"""

_NEAR_DUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 1 THEN [words[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) END AS s
  FROM w
), classes AS (
  SELECT min(doc_id) AS cid, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT cid, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.cid AS a, b.cid AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.cid < b.cid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT cid, cid AS other FROM classes
  UNION
  SELECT r.cid, e.b FROM reached r JOIN both_ways e ON r.other = e.a
), component AS (
  SELECT cid, min(other) AS c FROM reached GROUP BY cid
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(c, sets.doc_id) AS component_id, coalesce(c, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN component USING (cid)
"""

# DuckDB has no crc32: it is folded over the text's bytes with the usual table of 256 remainders.
_SHARDING = """
WITH RECURSIVE remainders AS (
  SELECT 0 AS step, i AS b, i AS r FROM range(0, 256) AS g(i)
  UNION ALL
  SELECT step + 1, b, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM remainders WHERE step < 8
), lookup AS (
  SELECT list(r ORDER BY b) AS t FROM remainders WHERE step = 8
), d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), texts AS (
  SELECT text, hex(encode(text)) AS h, strlen(text) AS n FROM (SELECT DISTINCT text FROM d)
), bytes AS (
  SELECT text, list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS bs FROM texts
), digests AS (
  SELECT text, xor(list_reduce(bs, lambda r, b: xor(r // 256, t[xor(r, b) % 256 + 1])), 4294967295) AS crc FROM bytes, lookup
), hashed AS (
  SELECT doc_id, strlen(text) + 1 AS size, crc, source, md5('23:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || crc || ':' || (strlen(text) + 1)) AS digest
  FROM d JOIN digests USING (text)
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY digest, doc_id, crc, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY f, digest, doc_id, crc, size, source) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * 16 // total AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY p * 16 // total ORDER BY p) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

_RANKING = r"""
WITH terms AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), tf AS (
  SELECT rid, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), sizes AS (
  SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS occurrences FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs
), wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), scores AS (
  SELECT item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // occurrences)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (rid), corpus
  GROUP BY item_id, rid, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

# crc32 as in op10's SQL, over the distinct runs of a document
_SPELLING = r"""
WITH RECURSIVE remainders AS (
  SELECT 0 AS step, i AS b, i AS r FROM range(0, 256) AS g(i)
  UNION ALL
  SELECT step + 1, b, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM remainders WHERE step < 8
), lookup AS (
  SELECT list(r ORDER BY b) AS t FROM remainders WHERE step = 8
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), named AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda r, b: xor(r // 256, t[xor(r, b) % 256 + 1])), 4294967295) AS crc
  FROM named, lookup
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION
  SELECT c.word, w.word FROM cut c JOIN words w ON c.a || c.b = w.word
  UNION
  SELECT w.word, c.word FROM cut c JOIN words w ON c.a || c.b = w.word
), ranked AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS r
  FROM near JOIN words o ON o.word = other
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain AS (
  SELECT word, word AS head, 0 AS step FROM forms
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.head WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(head, step) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN ends USING (word)
"""

ORACLES = {
    "op3_chat_formatting": _CHAT,
    "op5_quality_rules": _QUALITY,
    "op6_source_mixing": _MIXING,
    "op9_minhash_near_dedup": _NEAR_DUP,
    "op10_sharding": _SHARDING,
    "op11_ranked_search": _RANKING,
    "op12_spelling_variants": _SPELLING,
}
