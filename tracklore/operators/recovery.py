"""Tolerant reading of captions that a model wrote: what can be used is kept, the rest is counted.

All of it is Column expressions on one row; only a text that holds a whole ledger document
goes to the strict reader. Nothing fails a job: faults are in the columns `warnings` and
`error`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import text as tx
from . import codecs, ledger

KINDS = "|".join(ledger.TYPES)
ELEMENT = rf"(?is)<({KINDS})(\s[^<>]*)?(?<!/)>(.*?)</\1\s*>"  # kind, attributes, body
CLOSED = rf"(?is)<(?:{KINDS})(?:\s[^<>]*)?/>"  # an element without a body
YES = ["true", "1", "yes", "y"]


def attribute(attributes: Column, *names: str) -> Column:
    """The first of these attributes, in double quotes, that isn't empty; null if there is none."""
    one = lambda name: F.nullif(F.regexp_extract(attributes, rf'(?:^|\s){name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return F.coalesce(*map(one, names))


def shaped(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), value)


def elements(text: Column) -> Column:
    """The elements with a body, in order: array<struct<type, own_id, track_id, spans, text, verbatim, language, confidence>>.

    Null where an attribute is missing or can't be read; spans are null unless all are in order.
    """

    def element(kind: Column, attributes: Column, body: Column) -> Column:
        spans = tx.parsed_spans(F.coalesce(attribute(attributes, "t", "time", "spans"), F.lit("")))
        usable = (F.size(spans) > 0) & F.forall(spans, lambda s: (s["start_ds"] >= 0) & (s["end_ds"] > s["start_ds"]))
        flag = F.lower(F.trim(attribute(attributes, "verbatim")))
        return F.struct(
            F.lower(kind).alias("type"), shaped(attribute(attributes, "id"), "^E[0-9]+$").alias("own_id"), shaped(attribute(attributes, "track", "track_id"), "^T[0-9]+$").alias("track_id"),
            F.when(usable, spans).alias("spans"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("text"), flag.isin(YES).alias("verbatim"), attribute(attributes, "language").alias("language"),
            attribute(attributes, "confidence").try_cast("double").alias("confidence"),
        )

    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(ELEMENT), k).alias(n) for k, n in ((1, "kind"), (2, "attributes"), (3, "body"))))
    return F.transform(parts, lambda p: element(p["kind"], p["attributes"], p["body"]))


def unused_ids(found: Column) -> Column:
    """An id per element: its own if no element before has it, else E and its position from zero."""
    own = F.transform(found, lambda e, i: F.struct(e["own_id"].alias("id"), F.format_string("E%03d", i).alias("else_")))
    pick = lambda done, e: F.when(e["id"].isNull() | F.array_contains(done, F.coalesce(e["id"], F.lit(""))), e["else_"]).otherwise(e["id"])
    return F.aggregate(own, F.array().cast("array<string>"), lambda done, e: F.concat(done, F.array(pick(done, e))))


def tracks_of(events: Column) -> Column:
    """The tracks that events name, by id: kind by the events' types, spans united, the lowest confidence."""
    named = F.array_sort(F.array_distinct(F.filter(F.transform(events, lambda e: e["track_id"]), lambda t: t.isNotNull())))

    def track(t: Column, own: Column) -> Column:
        kinds = F.array_distinct(F.transform(own, lambda e: e["type"]))
        kind = F.when(F.size(kinds) > 1, F.lit("residual")).otherwise(ledger.kind_of_type(F.element_at(kinds, 1)))
        return F.struct(t.alias("id"), kind.alias("kind"), iv.merged(F.flatten(F.transform(own, lambda e: e["spans"]))).alias("spans"), F.array_min(F.transform(own, lambda e: e["confidence"])).alias("confidence"))

    return F.transform(named, lambda t: track(t, F.filter(events, lambda e: e["track_id"] == t)))


def in_seconds(items: Column) -> Column:
    """Events or tracks with their spans in seconds, as ledgers have them outside."""
    return F.transform(items, lambda e: e.withField("spans", F.transform(e["spans"], lambda s: F.struct(iv.seconds(s["start_ds"]).alias("start_sec"), iv.seconds(s["end_ds"]).alias("end_sec")))))


def ledger_json(sample_id: Column, duration: Column, tracks: Column, events: Column) -> Column:
    """A ledger as JSON text."""
    return F.to_json(F.struct(F.lit(ledger.VERSION).alias("schema_version"), sample_id.alias("sample_id"), duration.alias("duration_sec"), F.lit(0.1).alias("time_resolution_sec"), in_seconds(tracks).alias("tracks"), in_seconds(events).alias("events")))


def recovered(texts: DataFrame, text: str = "text", sample_id: str = "sample_id", duration: str = "duration_sec") -> DataFrame:
    """`texts` with ledger (JSON), ok, strict_format_success, events_recovered, events_rejected, warnings, error.

    A strict document is taken as it is. Else events are read one by one: a missing or odd
    confidence becomes 1.0 with a warning, an odd or used id E and its position, an odd
    track none; elements without text or times in order are rejected and counted. `error`
    says why the ledger isn't valid as a whole (an id twice, an event after the end).
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = texts.withColumn("strict_", codecs.from_xml(F.when(whole.contains("<ledger"), F.col(text)))).withColumn("found_", elements(whole))
    pairs = F.zip_with(F.col("found_"), unused_ids(F.col("found_")), lambda e, i: F.struct(i.alias("id"), e["type"].alias("type"), e["track_id"].alias("track_id"), e["spans"].alias("spans"), e["text"].alias("text"), e["verbatim"].alias("verbatim"), e["language"].alias("language"), e["confidence"].alias("confidence")))
    rows = rows.withColumn("kept_", F.filter(pairs, lambda e: e["spans"].isNotNull() & (e["text"] != "")))
    rows = rows.withColumn("events_", F.transform("kept_", lambda e: e.withField("confidence", F.coalesce(e["confidence"], F.lit(1.0)))))
    rows = rows.withColumn("tracks_", tracks_of(F.col("events_")))
    ids = F.transform("events_", lambda e: e["id"])
    late = F.exists("events_", lambda e: iv.offset(e["spans"]) > iv.grid(F.col(duration)))
    unsure = F.transform(F.filter("kept_", lambda e: e["confidence"].isNull()), lambda e: F.concat(F.lit("no usable confidence: "), e["id"]))
    notes = F.concat(F.when(whole.contains("<"), F.array(F.lit("not a strict document"))).otherwise(F.array().cast("array<string>")), unsure, F.when(F.size("tracks_") > 0, F.array(F.lit("tracks follow from events"))).otherwise(F.array().cast("array<string>")))
    strict = F.col("strict_.ledger").isNotNull()
    n_strict = F.size(F.from_json(F.col("strict_.ledger"), "struct<events:array<struct<id:string>>>")["events"])
    rejected = F.size("found_") - F.size("events_") + F.regexp_count(whole, F.lit(CLOSED))
    none = F.array().cast("array<string>")
    named = F.to_json(F.struct(F.col(sample_id).alias("sample_id")))
    own = F.concat(F.regexp_replace(named, r"\}$", ","), F.regexp_replace("strict_.ledger", r'^\{"sample_id": "(?:[^"\\]|\\.)*",?', ""))
    return rows.withColumns(
        {
            "ledger": F.when(strict, F.when(F.col(sample_id).isNull(), F.col("strict_.ledger")).otherwise(own)).otherwise(ledger_json(F.col(sample_id), F.col(duration), F.col("tracks_"), F.col("events_"))),
            "ok": strict, "strict_format_success": strict,
            "events_recovered": F.when(strict, n_strict).otherwise(F.size("events_")).cast("long"), "events_rejected": F.when(strict, 0).otherwise(rejected).cast("long"),
            "warnings": F.when(strict, none).otherwise(notes),
            "error": F.when(~strict, F.when(F.size(F.array_distinct(ids)) < F.size(ids), "an id occurs twice").when(late, "an event ends after the clip")),
        }
    ).drop("strict_", "found_", "kept_", "events_", "tracks_")


def cascade(texts: DataFrame, text: str = "text", sample_id: str = "sample_id", duration: str = "duration_sec", salvage: bool = False) -> DataFrame:
    """`recovered`, but captions of time tokens are read as such first; `form` says how: atomic, strict, tolerant, or empty.

    Time-token events whose ledger isn't valid (spans that overlap in an event, an end after
    the clip) leave the text to the tolerant reader, which finds nothing in it; with
    `salvage` the valid ones are kept. An empty caption (`<empty/>`) is a tolerant read
    without events, as no element is in it; `form` tells it.
    """
    fits = lambda e: iv.disjoint(e["spans"]) & (iv.offset(e["spans"]) <= iv.grid(F.col(duration)))
    rows = recovered(texts.withColumn("parsed_", tx.parsed_atomic(F.col(text))), text, sample_id, duration)
    if salvage:
        rows = rows.withColumn("parsed_", F.filter("parsed_", fits))
    atomic = (F.size("parsed_") > 0) & F.forall("parsed_", fits)
    made = ledger_json(F.col(sample_id), F.col(duration), tx.ledger_tracks(F.col("parsed_")), tx.ledger_events(F.col("parsed_")))
    empty = F.trim(F.coalesce(text, F.lit(""))).isin(tx.EMPTY, tx.EMPTY_SLOTS)
    form = F.when(atomic, "atomic").when(F.col("ok"), "strict").when(empty, "empty").otherwise("tolerant")
    none = F.array().cast("array<string>")
    taken = {"ledger": made, "ok": F.lit(True), "strict_format_success": F.lit(True), "events_recovered": F.size("parsed_").cast("long"), "events_rejected": F.lit(0).cast("long"), "warnings": none, "error": F.lit(None).cast("string")}
    return rows.withColumns({k: F.when(atomic, v).otherwise(F.col(k)) for k, v in taken.items()} | {"form": form}).drop("parsed_")
