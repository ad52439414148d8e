"""Queries over transcripts and speaker turns, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import speech
from . import bindings as b
from . import sql
from .evaluation import both


def misheard(text: Column) -> Column:
    """A transcript with faults at fixed places: each seventh word is lost, each ninth is another, after each eleventh one is added."""
    each = F.transform(F.split(F.lower(text), r"\s+"), lambda w, i: F.when(i % 7 == 3, F.lit("")).when(i % 9 == 5, F.lit("hm")).when(i % 11 == 7, F.concat(w, F.lit(" uh"))).otherwise(w))
    return F.array_join(each, " ")


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations, and what was heard: with faults, and each fourth turn given to a speaker of its own name."""
    t = b.table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("role").alias("speaker"), F.col("turn").alias("pos"), "text")
    heard = t.withColumn("speaker", F.when(F.col("pos") % 4 == 3, F.lit("S9")).otherwise(F.concat(F.lit("S"), F.length("speaker").cast("string")))).withColumn("text", misheard(F.col("text")))
    return t, heard


def word_error_rates(spark: SparkSession, d: str) -> DataFrame:
    t = b.table(spark, d, "conversations")
    rated = speech.error_rates(t.select("conv_id", "turn", F.col("text").alias("ref_text"), misheard(F.col("text")).alias("hyp_text")))
    counts = {c: F.col(c).cast("long") for c in ("n_words", "word_errors", "n_chars", "char_errors")}
    return rated.withColumns(counts).select("conv_id", "turn", "n_words", "word_errors", "wer", "n_chars", "char_errors", "cer")


def corpus_word_errors(spark: SparkSession, d: str) -> DataFrame:
    return speech.corpus_error_rate(word_error_rates(spark, d))


def speaker_word_errors(spark: SparkSession, d: str) -> DataFrame:
    return speech.cpwer(*turns(spark, d)).withColumnRenamed("sample_id", "conv_id")


def diarization_errors(spark: SparkSession, d: str) -> DataFrame:
    """Event types as speakers: who was found speaking has other names, as predictions of a type are split by their text."""
    refs, hyps = both(spark, d)
    return speech.diarization(refs.select("sample_id", F.col("type").alias("speaker"), "spans"), hyps.select("sample_id", F.concat("text", F.lit("?")).alias("speaker"), "spans"))


QUERIES = {f.__name__: f for f in (word_error_rates, corpus_word_errors, speaker_word_errors, diarization_errors)}

HEARD = "array_to_string([CASE WHEN i % 7 = 4 THEN '' WHEN i % 9 = 6 THEN 'hm' WHEN i % 11 = 8 THEN w || ' uh' ELSE w END for w, i in string_split_regex(lower({0}), '\\s+')], ' ')"
SPLIT = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> '')"
# One row of the table of edit distances after the other; a cell's way from the left is a running minimum.
WORD_ERRORS = f"""pairs AS (SELECT conv_id, turn, {SPLIT.format('text')} AS r, {SPLIT.format(HEARD.format('text'))} AS h FROM conversations),
steps AS (SELECT conv_id, turn, r, h, 0::BIGINT AS i, range(0, len(h) + 1) AS d FROM pairs
  UNION ALL SELECT conv_id, turn, r, h, i + 1, [list_min(t[1 : j + 1]) + j for j in range(0, len(h) + 1)] FROM (
    SELECT *, [CASE WHEN j = 0 THEN i + 1 ELSE least(d[j + 1] + 1, d[j] + CASE WHEN h[j] = r[i + 1] THEN 0 ELSE 1 END) END - j for j in range(0, len(h) + 1)] AS t FROM steps WHERE i < len(r))),
far AS (SELECT conv_id, turn, len(r) AS n_words, d[len(h) + 1] AS word_errors, array_to_string(r, ' ') AS rc, array_to_string(h, ' ') AS hc FROM steps WHERE i = len(r)),
plain AS (SELECT *, translate(rc, 'àáâäæçèéêëíîïñóôöœùúûüß¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWXY') AS ra, translate(hc, 'àáâäæçèéêëíîïñóôöœùúûüß¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWXY') AS ha FROM far),
rated AS (SELECT conv_id, turn, n_words, word_errors, CASE WHEN n_words > 0 THEN round(word_errors / n_words, 6) ELSE (word_errors > 0)::INT::DOUBLE END AS wer,
  length(rc) AS n_chars, levenshtein(ra, ha) AS char_errors, CASE WHEN length(rc) > 0 THEN round(levenshtein(ra, ha) / length(rc), 6) ELSE (hc <> '')::INT::DOUBLE END AS cer FROM plain)"""

DIARIZED = f"""WITH RECURSIVE {sql.BOTH},
rf AS (SELECT DISTINCT sample_id, type AS ref, unnest(range(start_ds, end_ds)) AS f FROM refs),
hf AS (SELECT DISTINCT sample_id, text || '?' AS hyp, unnest(range(start_ds, end_ds)) AS f FROM hyps),
once AS (SELECT coalesce(r.sample_id, h.sample_id) AS sample_id, coalesce(nr, 0) AS nr, coalesce(nh, 0) AS nh FROM (SELECT sample_id, f, count(*) AS nr FROM rf GROUP BY ALL) r FULL JOIN (SELECT sample_id, f, count(*) AS nh FROM hf GROUP BY ALL) h ON r.sample_id = h.sample_id AND r.f = h.f),
time AS (SELECT sample_id, sum(nr)::BIGINT AS ref_ds, sum(nh)::BIGINT AS hyp_ds, sum(greatest(nr, nh))::BIGINT AS most_ds, sum(least(nr, nh))::BIGINT AS both_ds FROM once GROUP BY ALL),
common AS (SELECT r.sample_id, ref, hyp, count(*) AS c FROM rf r JOIN hf h ON r.sample_id = h.sample_id AND r.f = h.f GROUP BY ALL),
ranked AS (SELECT *, c * 1048576 + CAST(('0x' || substr(md5(sample_id || '/speaker/' || ref || '/' || hyp), 1, 5)) AS BIGINT) AS units, dense_rank() OVER (PARTITION BY sample_id ORDER BY ref) AS k FROM common),
tries AS (SELECT DISTINCT sample_id, 0::BIGINT AS k, []::VARCHAR[] AS used, []::VARCHAR[] AS taken, 0::BIGINT AS units FROM ranked
  UNION ALL SELECT t.sample_id, t.k + 1, CASE WHEN o.h IS NULL THEN t.used ELSE list_append(t.used, o.h) END, list_append(t.taken, o.h), t.units + o.units
  FROM tries t JOIN (SELECT sample_id, k, hyp AS h, units FROM ranked UNION ALL SELECT DISTINCT sample_id, k, NULL, 0 FROM ranked) o ON o.sample_id = t.sample_id AND o.k = t.k + 1 AND NOT coalesce(list_contains(t.used, o.h), false)),
best AS (SELECT * FROM tries JOIN (SELECT sample_id, max(k) AS k FROM ranked GROUP BY ALL) USING (sample_id, k) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY units DESC) = 1),
won AS (SELECT sample_id, unnest(range(1, k + 1)) AS k, unnest(taken) AS hyp FROM best),
mapped AS (SELECT r.sample_id, r.ref, r.hyp, c FROM ranked r SEMI JOIN won USING (sample_id, k, hyp)),
lr AS (SELECT sample_id, ref, count(*) AS n FROM rf GROUP BY ALL), lh AS (SELECT sample_id, hyp, count(*) AS n FROM hf GROUP BY ALL),
jer AS (SELECT lr.sample_id, round(avg(CASE WHEN m.c IS NULL THEN 1.0::DOUBLE ELSE 1 - m.c / (lr.n + lh.n - m.c) END), 6) AS jer, coalesce(sum(m.c), 0)::BIGINT AS right_ds
  FROM lr LEFT JOIN mapped m ON m.sample_id = lr.sample_id AND m.ref = lr.ref LEFT JOIN lh ON lh.sample_id = m.sample_id AND lh.hyp = m.hyp GROUP BY ALL)
SELECT t.sample_id, ref_ds, most_ds - hyp_ds AS missed_ds, most_ds - ref_ds AS false_ds, both_ds - right_ds AS confused_ds, round((most_ds - hyp_ds + most_ds - ref_ds + both_ds - right_ds) / CAST(ref_ds AS DOUBLE), 6) AS der, jer FROM time t JOIN jer j ON j.sample_id = t.sample_id"""

ORACLES = {
    "word_error_rates": f"WITH RECURSIVE {WORD_ERRORS} SELECT * FROM rated",
    "corpus_word_errors": f"WITH RECURSIVE {WORD_ERRORS} SELECT count(*) AS n, sum(n_words)::BIGINT AS n_words, sum(word_errors)::BIGINT AS word_errors, sum(n_chars)::BIGINT AS n_chars, sum(char_errors)::BIGINT AS char_errors, "
    "round(sum(word_errors) / sum(n_words), 6) AS wer, round(sum(char_errors) / sum(n_chars), 6) AS cer FROM rated",
    "diarization_errors": DIARIZED,
}
