"""Errors of transcripts and of speaker turns: WER, CER, cpWER, DER and JER."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from . import metrics, sweep

#: The first of the code points that stand for words, beyond the surrogates; the highest is U+10FFFF.
FIRST = 0xE000


def words(text: Column) -> Column:
    """Words in lower case; null counts as none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def edit_distance(a: Column, b: Column) -> Column:
    """Least number of words to replace, insert or drop that makes array `a` array `b`.

    Each distinct word of a row becomes one code point, so that Spark's own edit distance
    of texts counts words. A row may have about a million distinct words.
    """
    letters = lambda row, all_: F.decode(F.unhex(F.array_join(F.transform(row, lambda w: F.lpad(F.hex(F.array_position(all_, w) + FIRST), 8, "0")), "")), "UTF-32")
    both = lambda all_: F.levenshtein(letters(a, all_), letters(b, all_))
    return iv.let(F.array_distinct(F.concat(a, b)), both)


def error_rates(pairs: DataFrame, ref: str = "ref_text", hyp: str = "hyp_text") -> DataFrame:
    """`pairs` with n_words, word_errors, wer, n_chars, char_errors and cer of the hypothesis.

    Null texts count as empty; without a reference a rate is 0 if there is no hypothesis
    either, else 1. Characters are those of the words, joined by single spaces.
    """
    r, h = words(F.col(ref)), words(F.col(hyp))
    joined = lambda x: F.array_join(x, " ")
    rows = pairs.withColumns({"ref__": r, "hyp__": h}).withColumns({"n_words": F.size("ref__"), "word_errors": edit_distance(F.col("ref__"), F.col("hyp__"))})
    rows = rows.withColumns({"n_chars": F.length(joined(F.col("ref__"))), "char_errors": F.levenshtein(joined(F.col("ref__")), joined(F.col("hyp__")))})
    return rows.withColumns({"wer": rate(F.col("word_errors"), F.col("n_words")), "cer": rate(F.col("char_errors"), F.col("n_chars"))}).drop("ref__", "hyp__")


def rate(errors: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, errors / whole).otherwise((errors > 0).cast("double")), 6)


def corpus_error_rate(rows: DataFrame) -> DataFrame:
    """One row: all errors over all words and characters, not the mean of the rates."""
    sums = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_words", "word_errors", "n_chars", "char_errors")))
    return sums.select("*", rate(F.col("word_errors"), F.col("n_words")).alias("wer"), rate(F.col("char_errors"), F.col("n_chars")).alias("cer"))


def spoken(turns: DataFrame) -> DataFrame:
    """(sample_id, speaker, words): what each speaker says, in order of `pos`, from (sample_id, speaker, pos, text)."""
    said = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return turns.groupBy("sample_id", "speaker").agg(words(F.array_join(F.transform(said, lambda x: F.coalesce(x["text"], F.lit(""))), " ")).alias("words"))


def cpwer(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """(sample_id, n_words, errors, cpwer): WER of the speakers' joined turns under the best pairing of speakers.

    `refs` and `hyps` have (sample_id, speaker, pos, text). Pairing two speakers saves the
    words of both less their edit distance; the pairing that saves most is found per clip.
    A speaker without a partner has all words wrong. Clips without references aren't rated.
    """
    side = lambda df, p: spoken(df).select("sample_id", F.col("speaker").alias(f"{p}_event_id"), F.col("words").alias(p))
    r, h = side(refs, "ref"), side(hyps, "hyp")
    pairs = r.join(h, "sample_id").withColumn("type", F.lit("speaker"))  # the few speakers of one clip
    saved = F.size("ref") + F.size("hyp") - edit_distance(F.col("ref"), F.col("hyp"))
    once = F.inline_outer(F.array(F.struct(saved.alias("saved"))))  # as a plain column it would be computed in the join, to leave pairs out, and again after it
    best = sweep.heaviest(pairs.select("sample_id", "type", "ref_event_id", "hyp_event_id", once), F.col("saved") / 1_000_000)
    rows = [r.select("sample_id", F.size("ref").alias("n_words")), h.select("sample_id", F.size("hyp").alias("n_hyp")), best.select("sample_id", "saved")]
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    clip = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).groupBy("sample_id").agg(F.count("n_words").alias("known"), *(count(c).alias(c) for c in ("n_words", "n_hyp", "saved")))
    errors = F.col("n_words") + F.col("n_hyp") - F.col("saved")
    return clip.where("known > 0").select("sample_id", "n_words", errors.alias("errors"), rate(errors, F.col("n_words")).alias("cpwer"))


def merged_turns(turns: DataFrame) -> DataFrame:
    """(sample_id, speaker, spans): each speaker's spans, united."""
    return turns.groupBy("sample_id", "speaker").agg(iv.merged(F.flatten(F.collect_list("spans"))).alias("spans"))


def at_once(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """(sample_id, ref_ds, hyp_ds, most_ds, both_ds): speaker time, and tenths times the larger and smaller number of speakers.

    A sweep over the ends of turns: each changes the number of speakers by one, and running
    sums per clip give the numbers between two ends. Only ends are held, not tenths.
    """
    def ends(df: DataFrame, which: str) -> DataFrame:
        span = merged_turns(df).select("sample_id", F.explode("spans").alias("s"))
        steps = F.explode(F.array(F.struct(F.col("s.start_ds").alias("at"), F.lit(1).alias("by")), F.struct(F.col("s.end_ds").alias("at"), F.lit(-1).alias("by"))))
        return span.select("sample_id", steps.alias("e")).select("sample_id", "e.at", F.col("e.by").alias(which))

    steps = ends(refs, "ref").unionByName(ends(hyps, "hyp"), allowMissingColumns=True)
    steps = steps.groupBy("sample_id", "at").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ref", "hyp")))
    order = Window.partitionBy("sample_id").orderBy("at")
    now = steps.select("sample_id", (F.lead("at").over(order) - F.col("at")).alias("long"), *(F.sum(c).over(order).alias(c) for c in ("ref", "hyp")))
    time = lambda n: F.coalesce(F.sum(n * F.col("long")), F.lit(0)).cast("long")
    return now.groupBy("sample_id").agg(
        time(F.col("ref")).alias("ref_ds"), time(F.col("hyp")).alias("hyp_ds"), time(F.greatest("ref", "hyp")).alias("most_ds"), time(F.least("ref", "hyp")).alias("both_ds"),
    )


def mapped_speakers(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """(sample_id, ref_speaker, hyp_speaker, common_ds, all_ds): the one-to-one mapping of speakers with most time in common."""
    side = lambda df, p: merged_turns(df).select("sample_id", F.col("speaker").alias(f"{p}_event_id"), F.col("spans").alias(f"{p}_spans"))
    pairs = side(refs, "ref").join(side(hyps, "hyp"), "sample_id").withColumn("type", F.lit("speaker"))
    pairs = pairs.withColumn("common_ds", iv.common(F.col("ref_spans"), F.col("hyp_spans"))).withColumn("all_ds", iv.length(F.col("ref_spans")) + iv.length(F.col("hyp_spans")) - F.col("common_ds"))
    best = sweep.heaviest(pairs.drop("ref_spans", "hyp_spans"), F.col("common_ds") / 1_000_000)
    return best.select("sample_id", F.col("ref_event_id").alias("ref_speaker"), F.col("hyp_event_id").alias("hyp_speaker"), "common_ds", "all_ds")


def diarization(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """(sample_id, ref_ds, missed_ds, false_ds, confused_ds, der, jer) per clip that has a reference turn.

    `refs` and `hyps` have (sample_id, speaker, spans). Where more speak than were found the
    rest is missed, where fewer do it is false; of those that were found, the time outside of
    the mapping is confused. DER is their sum over the reference time. JER is the mean over
    reference speakers of 1 - common / all time with the mapped speaker, 1 without one.
    """
    time, mapping = at_once(refs, hyps), mapped_speakers(refs, hyps)
    speakers = merged_turns(refs).select("sample_id", F.col("speaker").alias("ref_speaker")).join(mapping, ["sample_id", "ref_speaker"], "left")
    lost = F.coalesce(1 - F.col("common_ds") / F.col("all_ds"), F.lit(1.0))
    jer = speakers.groupBy("sample_id").agg(F.round(F.avg(lost), 6).alias("jer"), F.coalesce(F.sum("common_ds"), F.lit(0)).cast("long").alias("right_ds"))
    rows = time.join(jer, "sample_id").select("sample_id", "ref_ds", (F.col("most_ds") - F.col("hyp_ds")).alias("missed_ds"), (F.col("most_ds") - F.col("ref_ds")).alias("false_ds"), (F.col("both_ds") - F.col("right_ds")).alias("confused_ds"), "jer")
    wrong = F.col("missed_ds") + F.col("false_ds") + F.col("confused_ds")
    return rows.select("sample_id", "ref_ds", "missed_ds", "false_ds", "confused_ds", rate(wrong, F.col("ref_ds")).alias("der"), "jer")
