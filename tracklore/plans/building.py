"""Queries over built ledgers, training items and slots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import text as tx
from ..operators import activity as ac
from ..operators import building, slots
from ..operators import ledger as lg
from . import bindings as b
from . import captions, signals, sql

SLOTS = 6


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Sources of clips: the events of a type are one source, active where they are; gaps below 0.3 s are closed."""
    refs = b.references(spark, d).groupBy("sample_id", "type", "track_id").agg(iv.merged(F.flatten(F.collect_list("spans")), 3).alias("spans"))
    return refs.select("sample_id", F.col("track_id").alias("pos"), lg.kind_of_type(F.col("type")).alias("kind"), F.lit(None).cast("string").alias("identity"), F.col("type").alias("text"), "spans")


def event_rows(events: DataFrame) -> DataFrame:
    return events.select("sample_id", "event_id", F.col("ord").cast("long").alias("ord"), "type", "track_id", "verbatim", "confidence", F.size("spans").cast("long").alias("n_spans"), iv.onset(F.col("spans")).cast("long").alias("start_ds"), iv.offset(F.col("spans")).cast("long").alias("end_ds"))


def build_ledger(spark: SparkSession, d: str) -> DataFrame:
    sources = placed(spark, d)
    clips = sources.select("sample_id").distinct().select("sample_id", F.lit(b.CLIP_DS).alias("duration_ds"), F.lit("day").alias("template"))
    built = building.built_ledgers(clips, sources).select("sample_id", "overlap_ratio", F.size("tracks").cast("long").alias("n_tracks"), F.explode("events").alias("e"))
    return built.select("sample_id", "overlap_ratio", "n_tracks", F.col("e.id").alias("event_id"), "e.type", "e.track_id", "e.verbatim", "e.confidence", F.size("e.spans").cast("long").alias("n_spans"), iv.onset(F.col("e.spans")).cast("long").alias("start_ds"), iv.offset(F.col("e.spans")).cast("long").alias("end_ds"))


def activity_to_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events of clips of one source each, whose spans are detected in its waveform."""
    kinds = F.array(*map(F.lit, ("speech", "vocal", "music", "ambience")))
    spans = ac.activity_spans(F.col("wave"), signals.HOP, 1, F.lit(signals.FRAMES), threshold=0.5, gap=3)
    sources = b.waves(spark, d).select(F.col("vec_id").cast("string").alias("sample_id"), F.lit(0).alias("pos"), F.element_at(kinds, (F.col("vec_id") % 4 + 1).cast("int")).alias("kind"), F.lit("source").alias("text"), spans.alias("spans"))
    return event_rows(building.built_events(sources))


def dataset_items(spark: SparkSession, d: str) -> DataFrame:
    refs = b.references(spark, d)
    groups = building.source_group(refs.select("sample_id", F.concat(F.lit("wav/"), "track_id").alias("path")))
    clips = lg.nested(refs).join(groups, "sample_id").withColumn("duration_ds", F.lit(b.CLIP_DS))
    return building.items(clips, F.col("group")).drop("prompt")


def slot_target_rows(spark: SparkSession, d: str) -> DataFrame:
    clips = lg.nested(b.references(spark, d))
    return clips.select("sample_id", F.posexplode(slots.slot_targets(F.col("events"), b.CLIP_DS, SLOTS)).alias("pos", "target"))


def slot_targets(spark: SparkSession, d: str) -> DataFrame:
    return slot_target_rows(spark, d).select("sample_id", F.col("pos").cast("long").alias("pos"), *(F.col(f"target.{c}").cast("long").alias(c) for c in ("type_index", "onset", "offset")), "target.valid")


def wave_slots(spark: SparkSession, d: str) -> DataFrame:
    """Eight slots of a clip from its 64 samples: eventness, four probabilities, a mask of three frames."""
    part = lambda w, i, n: F.transform(F.slice(w, i, n), lambda x: F.abs(x))
    rows = b.waves(spark, d).select(F.col("vec_id").cast("string").alias("sample_id"), "wave", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot"))
    return rows.select("sample_id", "slot", (F.abs(F.element_at("wave", F.col("slot") * 8 + 1)) * 4).alias("eventness"), part(F.col("wave"), F.col("slot") * 8 + 2, 4).alias("type_probs"), F.transform(part(F.col("wave"), F.col("slot") * 8 + 6, 3), lambda x: x * 5).alias("activity"))


def slot_events(spark: SparkSession, d: str) -> DataFrame:
    found = slots.slot_events(wave_slots(spark, d))
    return found.select("sample_id", "event_id", F.col("slot").cast("long").alias("slot"), "type", iv.onset(F.col("spans")).cast("long").alias("start_ds"), iv.offset(F.col("spans")).cast("long").alias("end_ds"), "confidence")


def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Slots made of predictions against targets made of references, by boundaries: the number of pairs and their cost per clip."""
    hyps = b.predictions(spark, d)
    kind = lambda t: F.when(F.col("type") == t, 0.7).otherwise(0.1)
    made = hyps.select("sample_id", F.col("ord").alias("slot"), F.array(*map(kind, tx.TYPES)).alias("type_probs"), iv.onset(F.col("spans")).alias("onset_ds"), iv.offset(F.col("spans")).alias("offset_ds"))
    pairs = slots.slot_assignment(slots.slot_costs(made, slot_target_rows(spark, d), b.CLIP_DS))
    return pairs.groupBy("sample_id").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("cost") * 1_000_000).cast("long")) / 1_000_000).alias("cost"))


QUERIES = {f.__name__: f for f in (build_ledger, activity_to_ledger, dataset_items, slot_targets, slot_events, slot_assignment)}

CONFIDENCE = "CASE type " + " ".join(f"WHEN '{t}' THEN {c}::DOUBLE" for t, c in building.EVENT_CONFIDENCE.items()) + " END"
VERBATIM = "CASE type WHEN 'lys' THEN true WHEN 'speech' THEN false END"
# All matchings of a clip, target by target: as many pairs as targets or slots allow, at the least cost in millionths.
SLOT_PAIRS = f"""WITH RECURSIVE {sql.BOTH}, n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1 AS pos FROM refs),
t AS (SELECT sample_id, pos, type, least(300, start_ds) AS onset, greatest(least(300, start_ds) + 1, least(300, end_ds)) AS "offset" FROM n WHERE pos < {SLOTS}),
costs AS (SELECT t.sample_id, t.pos, h.ord AS slot, CASE WHEN h.type = t.type THEN 1 - 0.7::DOUBLE ELSE 1 - 0.1::DOUBLE END + (abs(h.start_ds - onset) + abs(h.end_ds - "offset")) / (2.0::DOUBLE * greatest(1, "offset" - onset)) AS cost FROM t JOIN hyps h ON h.sample_id = t.sample_id),
units AS (SELECT *, CAST(round(cost * 1000000) AS BIGINT) * 1048576 + CAST(('0x' || substr(md5(sample_id || '/' || pos || '/' || slot), 1, 5)) AS BIGINT) AS units FROM costs),
tries AS (SELECT DISTINCT sample_id, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS units, 0::BIGINT AS cost FROM units
  UNION ALL SELECT t.sample_id, t.k + 1, CASE WHEN o.slot IS NULL THEN t.used ELSE list_append(t.used, o.slot) END, t.units + o.units, t.cost + o.cost
  FROM tries t JOIN (SELECT sample_id, pos, slot, units, units // 1048576 AS cost FROM units UNION ALL SELECT DISTINCT sample_id, pos, NULL, 0, 0 FROM units) o ON o.sample_id = t.sample_id AND o.pos = t.k AND NOT coalesce(list_contains(t.used, o.slot), false)),
best AS (SELECT * FROM tries JOIN (SELECT sample_id, max(pos) + 1 AS k FROM units GROUP BY ALL) USING (sample_id, k) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY len(used) DESC, units) = 1)
SELECT sample_id, len(used) AS n, cost / 1000000.0::DOUBLE AS cost FROM best"""
ORACLES = {
    "build_ledger": f"""WITH {sql.REFS},{sql.islands('refs', 'sample_id, type', 3)},
tracks AS (SELECT sample_id, type, 'T' || row_number() OVER (PARTITION BY sample_id ORDER BY {captions.RANK}) AS track_id, row_number() OVER (PARTITION BY sample_id ORDER BY {captions.RANK}) AS pos FROM (SELECT DISTINCT sample_id, type FROM refs)),
parts AS (SELECT sample_id, type, 1 AS n_spans, start_ds, end_ds FROM merged_refs WHERE type IN ('speech', 'lys') UNION ALL SELECT sample_id, type, count(*), min(start_ds), max(end_ds) FROM merged_refs WHERE type NOT IN ('speech', 'lys') GROUP BY ALL),
frames AS (SELECT DISTINCT sample_id, type, unnest(range(start_ds, end_ds)) AS f FROM merged_refs), busy AS (SELECT sample_id, f, count(*) AS k FROM frames GROUP BY ALL), ratios AS (SELECT sample_id, round(count(*) FILTER (k >= 2) / 300.0::DOUBLE, 6) AS overlap_ratio FROM busy GROUP BY ALL)
SELECT p.sample_id, overlap_ratio, n_tracks, 'E' || lpad(CAST(row_number() OVER (PARTITION BY p.sample_id ORDER BY pos, start_ds) AS VARCHAR), 3, '0') AS event_id, type, track_id, {VERBATIM} AS verbatim, {CONFIDENCE} AS confidence, n_spans, start_ds, end_ds
FROM parts p JOIN tracks USING (sample_id, type) JOIN ratios USING (sample_id) JOIN (SELECT sample_id, max(pos) AS n_tracks FROM tracks GROUP BY ALL) USING (sample_id)""",
    "activity_to_ledger": f"""WITH {signals.SPANS}, parts AS (SELECT vec_id, 1 AS n_spans, start_ds, end_ds FROM spans WHERE vec_id % 4 < 2 UNION ALL SELECT vec_id, count(*), min(start_ds), max(end_ds) FROM spans WHERE vec_id % 4 > 1 GROUP BY ALL),
e AS (SELECT *, ['speech', 'lys', 'music', 'sfx'][vec_id % 4 + 1] AS type, row_number() OVER (PARTITION BY vec_id ORDER BY start_ds) AS k FROM parts)
SELECT CAST(vec_id AS VARCHAR) AS sample_id, 'E' || lpad(CAST(k AS VARCHAR), 3, '0') AS event_id, k - 1 AS ord, type, 'T1' AS track_id, {VERBATIM} AS verbatim, {CONFIDENCE} AS confidence, n_spans, start_ds, end_ds FROM e""",
    "dataset_items": f"WITH {sql.REFS} SELECT sample_id, 30.0::DOUBLE AS duration_sec, string_agg({captions.ONE}, '' ORDER BY start_ds, {captions.RANK}, event_id) AS target_atomic, string_agg({captions.XML}, chr(10) ORDER BY start_ds, {captions.RANK}, event_id) AS target_xml, "
    "substr(sha1(array_to_string(list_sort(list(DISTINCT 'wav/' || track_id)), '|')), 1, 12) AS \"group\" FROM refs GROUP BY ALL",
    "slot_targets": f"""WITH {sql.REFS}, n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1 AS pos FROM refs)
SELECT c.sample_id, c.pos, CASE WHEN n.pos IS NULL THEN 0 ELSE {captions.RANK} END AS type_index, CASE WHEN n.pos IS NULL THEN 0 ELSE least(300, start_ds) END AS onset, CASE WHEN n.pos IS NULL THEN 0 ELSE greatest(least(300, start_ds) + 1, least(300, end_ds)) END AS "offset", n.pos IS NOT NULL AS valid
FROM (SELECT sample_id, unnest(range(0, {SLOTS})) AS pos FROM (SELECT DISTINCT sample_id FROM refs)) c LEFT JOIN n ON n.sample_id = c.sample_id AND n.pos = c.pos""",
    "slot_events": f"""WITH w AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS w, unnest(range(0, 8)) AS slot FROM embeddings),
s AS (SELECT sample_id, slot, w[slot * 8 + 1] * 4 AS e, w[slot * 8 + 2 : slot * 8 + 5] AS p, list_transform(w[slot * 8 + 6 : slot * 8 + 8], lambda x: x * 5 > 0.5) AS m FROM w), k AS (SELECT * FROM s WHERE e >= 0.4 AND list_contains(m, true))
SELECT sample_id, 'E' || lpad(CAST(row_number() OVER (PARTITION BY sample_id ORDER BY slot) AS VARCHAR), 3, '0') AS event_id, slot, ['speech', 'lys', 'music', 'sfx'][list_position(p, list_max(p))] AS type, list_position(m, true) - 1 AS start_ds, 4 - list_position(list_reverse(m), true) AS end_ds, round(e, 3) AS confidence FROM k""",
    "slot_assignment": SLOT_PAIRS,
}
