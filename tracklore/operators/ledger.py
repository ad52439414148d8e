"""The ledger model: schemas, nesting and flattening.

A ledger describes a clip: tracks (source lanes), typed events and their spans. At the
edges it is one nested record; operators work on one row per event or track with its
spans as an array in tenths of a second. `ord` keeps list positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv

#: Fixed values of the ledger format.
VERSION = "0.2.0"
KINDS = ["speech", "vocal", "music", "sfx", "ambience", "residual"]
TYPES = ["speech", "lys", "music", "sfx"]
PREDICATES = ["before", "after", "overlaps", "interrupts", "causes", "echo_of"]
LABEL_LEVELS = ["A", "B", "C", "D", "E", "human", "model_prediction"]

SPAN_JSON = "struct<start_sec:double,end_sec:double,start_uncertainty_sec:double,end_uncertainty_sec:double>"
EVIDENCE_JSON = "struct<method:string,audio_support:double,target_residual_margin:double,av_support:double,waveform_uri:string,mask_uri:string>"
LEDGER_JSON = (
    "struct<schema_version:string,sample_id:string,duration_sec:double,time_resolution_sec:double,language:string,"
    "conditions:struct<domain:string,snr_db:double,t60_sec:double,echo:boolean,codec:string,overlap_ratio:double>,"
    f"tracks:array<struct<id:string,kind:string,identity:string,spans:array<{SPAN_JSON}>,audibility:double,confidence:double,evidence:{EVIDENCE_JSON},attributes:variant>>,"
    f"events:array<struct<id:string,type:string,track_id:string,spans:array<{SPAN_JSON}>,text:string,verbatim:boolean,language:string,confidence:double,evidence:{EVIDENCE_JSON},"
    "relations:array<struct<predicate:string,target_event_id:string>>,attributes:variant>>,"
    "provenance:struct<label_level:string,source_dataset:string,renderer_manifest_uri:string,teacher_versions:map<string,string>,license_status:string>>"
)


def to_tenths(spans: Column) -> Column:
    return F.transform(F.coalesce(spans, F.array().cast(f"array<{SPAN_JSON}>")), lambda s: iv.span(iv.grid(s["start_sec"]), iv.grid(s["end_sec"])))


def events_of(ledgers: DataFrame) -> DataFrame:
    """One row per event of `ledgers(sample_id, events)`: event_id, ord, type, track_id, text, confidence, spans."""
    rows = ledgers.select("sample_id", F.posexplode("events").alias("ord", "e"))
    return rows.select("sample_id", F.col("e.id").alias("event_id"), "ord", F.col("e.type").alias("type"), F.col("e.track_id").alias("track_id"), F.col("e.text").alias("text"), F.col("e.confidence").alias("confidence"), to_tenths(F.col("e.spans")).alias("spans"))


def tracks_of(ledgers: DataFrame) -> DataFrame:
    """One row per track of `ledgers(sample_id, tracks)`: track_id, ord, kind, identity, confidence, spans."""
    rows = ledgers.select("sample_id", F.posexplode("tracks").alias("ord", "t"))
    return rows.select("sample_id", F.col("t.id").alias("track_id"), "ord", F.col("t.kind").alias("kind"), F.col("t.identity").alias("identity"), F.col("t.confidence").alias("confidence"), to_tenths(F.col("t.spans")).alias("spans"))


def relations_of(ledgers: DataFrame) -> DataFrame:
    """One row per relation: sample_id, event_id, predicate, target_event_id."""
    rows = ledgers.select("sample_id", F.explode("events").alias("e")).select("sample_id", F.col("e.id").alias("event_id"), F.explode("e.relations").alias("r"))
    return rows.select("sample_id", "event_id", "r.predicate", "r.target_event_id")


def nested(events: DataFrame) -> DataFrame:
    """Per clip its events as an array in list order; the inverse of `events_of` on tenths."""
    fields = F.struct("ord", F.struct(F.col("event_id").alias("id"), "type", "track_id", "spans", "text", "confidence").alias("e"))
    return events.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["e"]).alias("events"))


def kind_of_type(kind: Column) -> Column:
    """Track kind of an event type."""
    return F.when(kind == "lys", "vocal").otherwise(kind)


def type_of_kind(kind: Column) -> Column:
    """Event type of a source kind."""
    return F.when(kind == "vocal", "lys").when(kind == "ambience", "sfx").otherwise(kind)


def inferred_tracks(events: DataFrame) -> DataFrame:
    """Tracks that events refer to: kind by their types, spans united, lowest confidence.

    One type gives its kind; several give residual.
    """
    grouped = events.where("track_id is not null").groupBy("sample_id", "track_id").agg(F.collect_set("type").alias("types"), F.flatten(F.collect_list("spans")).alias("spans"), F.min("confidence").alias("confidence"))
    kind = F.when(F.size("types") > 1, F.lit("residual")).otherwise(kind_of_type(F.element_at("types", 1)))
    return grouped.select("sample_id", "track_id", kind.alias("kind"), iv.merged(F.col("spans")).alias("spans"), "confidence")
