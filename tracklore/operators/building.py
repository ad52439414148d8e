"""Ledgers from placed sources and their activity, and the items of a training set made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import text as tx
from . import dataset, ledger

#: The confidence of built events by type, and of built tracks.
EVENT_CONFIDENCE = {"speech": 0.95, "lys": 0.88, "sfx": 0.93, "music": 0.94}
TRACK_CONFIDENCE = 0.95


def built_tracks(sources: DataFrame) -> DataFrame:
    """One row per source of `sources(sample_id, pos, kind, identity, spans)`: T1, T2, .. in order of pos.

    A silent source keeps a track with a span of the first tenth.
    """
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("pos"))
    spans = F.when(F.size("spans") > 0, F.col("spans")).otherwise(F.array(iv.span(F.lit(0), F.lit(1))))
    return sources.select("sample_id", F.concat(F.lit("T"), number.cast("string")).alias("track_id"), (number - 1).alias("ord"), "kind", "identity", F.lit(TRACK_CONFIDENCE).alias("confidence"), spans.alias("spans"))


def built_events(sources: DataFrame) -> DataFrame:
    """Events of `sources(sample_id, pos, kind, text, spans)`: event_id, ord, type, track_id, text, verbatim, confidence, spans.

    Speech and lyrics give an event per span of activity, other sources one with all their
    spans, silent ones none. Ids E001, .. follow the sources; `ord` is the canonical order.
    """
    track = F.concat(F.lit("T"), F.row_number().over(Window.partitionBy("sample_id").orderBy("pos")).cast("string"))
    rows = sources.withColumns({"track_id": track, "type": ledger.type_of_kind(F.col("kind"))})
    parts = F.when(F.col("type").isin("speech", "lys"), F.transform("spans", lambda s: F.array(s))).when(F.size("spans") > 0, F.array("spans"))
    rows = rows.select("sample_id", "pos", "track_id", "type", "text", F.posexplode(parts).alias("part", "spans"))
    clip = Window.partitionBy("sample_id")
    rows = rows.withColumn("event_id", F.format_string("E%03d", F.row_number().over(clip.orderBy("pos", "part"))))
    rank = F.array_position(F.array(*map(F.lit, tx.TYPES)), F.col("type"))
    confidence = F.create_map(*(F.lit(x) for kv in EVENT_CONFIDENCE.items() for x in kv))[F.col("type")]
    order = F.row_number().over(clip.orderBy(iv.onset(F.col("spans")), rank, "event_id")) - 1
    return rows.select("sample_id", "event_id", order.alias("ord"), "type", "track_id", "text", F.when(F.col("type") == "lys", True).when(F.col("type") == "speech", False).alias("verbatim"), confidence.alias("confidence"), "spans")


def built_ledgers(clips: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per clip of `clips(sample_id, duration_ds, template)`: duration_ds, overlap_ratio, template, tracks, events; silent clips included."""
    nest = lambda df, *fields: df.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))), lambda v: v["x"]).alias("all_"))
    tracks = nest(built_tracks(sources), F.col("track_id").alias("id"), "kind", "identity", "spans", "confidence").withColumnRenamed("all_", "tracks")
    events = nest(built_events(sources), F.col("event_id").alias("id"), "type", "track_id", "spans", "text", "verbatim", "confidence").withColumnRenamed("all_", "events")
    active = sources.groupBy("sample_id").agg(F.collect_list("spans").alias("active_"))
    rows = clips.join(tracks, "sample_id", "left").join(events, "sample_id", "left").join(active, "sample_id", "left")
    full = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c, df in (("tracks", tracks), ("events", events))}
    ratio = iv.overlap_ratio(F.coalesce("active_", F.array().cast(f"array<{iv.SPANS}>")), F.col("duration_ds"))
    return rows.withColumns(full).select("sample_id", "duration_ds", "template", ratio.alias("overlap_ratio"), "tracks", "events")


def prompt(style: Column | str = "brief", lyrics: bool = False) -> Column:
    """The instruction that goes with a clip, with the caption's style in it."""
    words = "Write down lyrics that can be understood as <lys>; name others as singing in <music>. " if lyrics else ""
    style = style if isinstance(style, Column) else F.lit(style)
    return F.concat(F.lit("List all events that can be heard, each with its type, times and text; events may overlap and have several times. [style="), style, F.lit(f", grid=0.1 s] {words}Leave out what the sound doesn't show."))


def items(ledgers: DataFrame, group: Column, style: str = "brief", lyrics: bool = False) -> DataFrame:
    """Training items of `ledgers(sample_id, duration_ds, events)`: prompt, both caption forms, the group that a split keeps whole."""
    return ledgers.select("sample_id", iv.seconds(F.col("duration_ds")).alias("duration_sec"), prompt(style, lyrics).alias("prompt"), tx.atomic_caption(F.col("events"), style).alias("target_atomic"), tx.xml_caption(F.col("events"), style).alias("target_xml"), group.alias("group"))


def source_group(sources: DataFrame) -> DataFrame:
    """(sample_id, group): the key of each clip's set of source paths, from `sources(sample_id, path)`."""
    return sources.groupBy("sample_id").agg(dataset.group_key(F.collect_set("path")).alias("group"))
