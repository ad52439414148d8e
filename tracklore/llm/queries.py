"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, fim, fingerprints, html_extract, langid, licenses, media, mixing, quality, simhash, substrings, toxicity
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what was measured on its stored media, read back."""
    return media.media_features(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of tokens and digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language and score."""
    return langid.languages(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses found in it."""
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licenses", "n_licenses")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and both likenesses."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled documents with their cell, weight and probability."""
    sampled = mixing.mixed(table(spark, sf_dir, "documents"), MIX, BUDGET)
    return sampled.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of it without windows of 50 words that a smaller id has."""
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language with their counts and score."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of its fill-in-the-middle output and of the text restored from it."""
    return fim.fill_in_middle(table(spark, sf_dir, "documents"))


#: Powers that flatten the shares of sources, languages and topics; part of the tokens that is sampled.
MIX, BUDGET = {"source": 0.5, "lang": 0.7, "topic": 0.5}, 0.5


SUBSTRINGS = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM listed WHERE len(words) >= 50)),
least AS (SELECT w, min(doc_id) AS doc_id FROM windows GROUP BY w),
gone AS (SELECT x.doc_id, x.i FROM windows x JOIN least l ON l.w = x.w AND l.doc_id < x.doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM listed),
marked AS (
  SELECT p.doc_id, p.word, p.i, coalesce(max(CASE WHEN g.i IS NOT NULL THEN 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS covered
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
kept AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(covered) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (covered = 0), '')) AS kept_sha256
  FROM marked GROUP BY doc_id)
SELECT l.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""

PHRASES = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM listed GROUP BY lang),
starts AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM listed, range(1, 6) AS sizes(size)),
grams AS (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase FROM starts),
counted AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, a, size, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM counted WHERE size > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score, c.k
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : c.k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.k + 1 :], ' ') JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, size, string_split(phrase, ' ') AS words, unnest(range(2, size)) AS s FROM counted WHERE size > 2),
places AS (SELECT lang, a, words, s, unnest(range(1, size - s + 2)) AS i FROM parts),
inside AS (SELECT lang, array_to_string(words[i : i + s - 1], ' ') AS phrase, max(a) AS longer FROM places GROUP BY 1, 2),
kept AS (SELECT w.* FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

FILL_IN_MIDDLE = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM texts),
cut AS (
  SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""


def queries() -> dict:
    """The queries of the operators."""
    made = (
        op1_simhash_near_dedup, op2_media_columns, op3_byte_bpe, op4_language_id, op5_quality,
        op6_license_scan, op7_toxicity, op8_document_fingerprints, op9_html_extraction, op10_source_mixing, op11_substring_dedup, op12_phrase_collocations, op13_fill_in_middle,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op11_substring_dedup": SUBSTRINGS, "op12_phrase_collocations": PHRASES, "op13_fill_in_middle": FILL_IN_MIDDLE}
