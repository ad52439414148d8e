"""Ledgers from separated stems: detected activity, or the reference's times; and checks of held-out clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import text as tx
from . import activity as ac
from . import ledger

#: Stems below this RMS are silent; spans of a stem and characters of a caption that are used; confidences.
SILENT, SPANS, CAPTION, CONFIDENCE = 0.005, 3, 80, 0.7
ORACLE_CAPTION, ORACLE_CONFIDENCE, ORACLE_DS = 100, 0.9, 20
#: The type of an event by its stem; stems whose sound goes on.
TYPE_OF_STEM = {"vocals": "lys", "drums": "sfx", "bass": "music", "other": "music"}
CONTINUOUS = ("other", "bass")


def loudness(wave: Column) -> Column:
    """Root mean square of a whole waveform; an empty one: 0."""
    return F.when(F.size(wave) > 0, F.sqrt(F.aggregate(wave, F.lit(0.0), lambda s, x: s + x * x) / F.size(wave))).otherwise(F.lit(0.0))


def clamped(spans: Column, duration_ds: Column) -> Column:
    """Spans moved into the clip: each starts a tenth before its end at least and lasts a tenth at least."""
    start = lambda s: F.greatest(F.lit(0), F.least(s["start_ds"], duration_ds - 1))
    return F.transform(spans, lambda s: iv.let(start(s), lambda a: iv.span(a, F.greatest(a + 1, F.least(s["end_ds"], duration_ds)))))


def numbered(events: DataFrame, *order: str) -> DataFrame:
    """`events` with event_id: E001, E002, .. per clip, in the given order."""
    return events.withColumn("event_id", F.format_string("E%03d", F.row_number().over(Window.partitionBy("sample_id").orderBy(*order))))


def stem_events(stems: DataFrame, hop: int, frames: int | Column, threshold: float = 0.1, gap: int = 3, silent: float = SILENT, most: int = SPANS, types: dict[str, str] = TYPE_OF_STEM, continuous: tuple[str, ...] = CONTINUOUS) -> DataFrame:
    """(sample_id, event_id, type, track_id, text, confidence, spans): events of detected activity.

    `stems` has sample_id, pos, stem, wave and caption (may be null), a row per separated
    stem. Silent stems and stems without activity give none, others an event for each of
    their first `most` spans. The text is the caption, cut, or else the stem's name. Stems
    of an unknown kind are sfx; null waves are silent.
    """
    n = frames if isinstance(frames, Column) else F.lit(frames)
    loud = stems.where(loudness(F.coalesce("wave", F.array().cast("array<double>"))) >= silent)
    spans = F.when(F.col("stem").isin(*continuous), ac.activity_spans(F.col("wave"), hop, 1, n, True, threshold, gap)).otherwise(ac.activity_spans(F.col("wave"), hop, 1, n, False, threshold, gap))
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in types.items() for x in kv))[F.col("stem")], F.lit("sfx"))
    said = F.coalesce(F.when(F.col("caption") != "", F.substring("caption", 1, CAPTION)), F.concat(F.lit("stem "), "stem"))
    rows = loud.select("sample_id", "pos", kind.alias("type"), F.lit(None).cast("string").alias("track_id"), said.alias("text"), F.lit(CONFIDENCE).alias("confidence"), F.posexplode(F.slice(spans, 1, most)).alias("part", "span"))
    return numbered(rows.withColumn("spans", F.array("span")), "pos", "part").select("sample_id", "event_id", "type", "track_id", "text", "confidence", "spans")


def oracle_events(sources: DataFrame, events: DataFrame) -> DataFrame:
    """(sample_id, event_id, type, track_id, text, confidence, spans): captions of stems at the reference's times.

    `sources` has sample_id, pos, kind, onset_ds, duration_ds, text and caption (both may be
    null). A source takes the spans of the clip's first event of its type, in canonical
    order; without one it lasts two seconds from its onset on, within the clip.
    """
    rank = F.array_position(F.array(*map(F.lit, tx.TYPES)), F.col("type"))
    first = events.groupBy("sample_id", "type").agg(F.min_by("spans", F.struct(iv.onset(F.col("spans")), rank, "event_id")).alias("spans"))
    kind = ledger.type_of_kind(F.col("kind"))
    typed = sources.withColumn("type", F.when(kind.isin(*tx.TYPES), kind).otherwise("sfx"))
    rows = typed.join(first, ["sample_id", "type"], "left")
    own = F.array(iv.span(F.col("onset_ds"), F.least(F.col("duration_ds"), F.col("onset_ds") + ORACLE_DS)))
    said = F.coalesce(F.when(F.col("caption") != "", F.substring("caption", 1, ORACLE_CAPTION)), "text", F.lit("an event"))
    made = rows.select("sample_id", "pos", "type", F.lit(None).cast("string").alias("track_id"), said.alias("text"), F.lit(ORACLE_CONFIDENCE).alias("confidence"), F.coalesce("spans", own).alias("spans"))
    return numbered(made, "pos").drop("pos")


def with_conditions(ledgers: DataFrame, conditions: DataFrame, provenance: dict[str, str | None]) -> DataFrame:
    """Built ledgers with `conditions` and `provenance`.

    `conditions` has sample_id, snr_db, t60_sec, echo_delay_ms and codec; a clip without a
    row has nulls and no echo. The domain is the clip's template; the overlap is the
    ledger's own. `provenance` gives the fields of the record that all ledgers carry.
    """
    rows = ledgers.join(conditions.select("sample_id", "snr_db", "t60_sec", "echo_delay_ms", "codec"), "sample_id", "left")
    found = F.struct(F.col("template").alias("domain"), "snr_db", "t60_sec", F.col("echo_delay_ms").isNotNull().alias("echo"), "codec", "overlap_ratio")
    origin = F.struct(*(F.lit(v).cast("string").alias(k) for k, v in provenance.items()))
    return rows.withColumns({"conditions": found, "provenance": origin}).drop("snr_db", "t60_sec", "echo_delay_ms", "codec")


def review_rows(clips: DataFrame, refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """One row per held-out clip to read side by side: both sides' events as text, the kind of error and counts of keys.

    `refs` and `hyps` are events; a key is a type and its first start. A clip without a
    prediction says so, and all its events are omissions.
    """
    tenth = lambda t: F.format_string("%d.%d", (t / 10).cast("int"), t % 10)
    shown = F.concat("type", F.lit(" ["), tenth(iv.onset(F.col("spans"))), F.lit("-"), tenth(iv.offset(F.col("spans"))), F.lit("] "), F.substring("text", 1, 40))
    side = lambda df, which: df.select("sample_id", F.lit(which).alias("side"), F.struct(iv.onset(F.col("spans")).alias("at"), "event_id", shown.alias("shown"), F.concat_ws(":", "type", iv.onset(F.col("spans")).cast("string")).alias("key")).alias("e"))
    of = lambda which: F.array_sort(F.collect_list(F.when(F.col("side") == which, F.col("e")))).alias(which)
    met = side(refs, "gt").unionByName(side(hyps, "pred")).groupBy("sample_id").agg(of("gt"), of("pred"))
    rows = clips.join(met, "sample_id", "left")
    none = F.array().cast(met.schema["gt"].dataType)
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("gt", "pred")})
    keys = lambda c: F.array_distinct(F.transform(c, lambda e: e["key"]))
    text = lambda c: F.array_join(F.transform(c, lambda e: e["shown"]), " | ")
    rows = rows.withColumns({"n_correct": F.size(F.array_intersect(keys("gt"), keys("pred"))), "n_halluc": F.size(F.array_except(keys("pred"), keys("gt"))), "n_omit": F.size(F.array_except(keys("gt"), keys("pred")))})
    match = F.when((F.col("n_halluc") == 0) & (F.col("n_omit") == 0), "correct").when(F.col("n_omit") == 0, "halluc").when(F.col("n_halluc") == 0, "omit").otherwise("mixed")
    return rows.select(
        *clips.columns, F.size("gt").alias("gt_n_events"), text("gt").alias("gt_events"), F.size("pred").alias("pred_n_events"), F.when(F.size("pred") > 0, text("pred")).otherwise("(parse failed)").alias("pred_events"),
        match.alias("match"), F.format_string("correct=%d halluc=%d omit=%d", "n_correct", "n_halluc", "n_omit").alias("errors"),
    )
