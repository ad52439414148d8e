"""Queries that split, check, edit and select ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import components, dataset, revisions
from . import bindings as b
from . import sql

FRACTION, SEED = 0.25, "components-1"
QUOTAS = {"en": 40, "de": 25, "fr": 25, "xx": 10}


def shipped(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clips; their sources are what a supplier sends on a day."""
    return b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), F.concat_ws("/", F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("path"))


def source_components(spark: SparkSession, d: str) -> DataFrame:
    return components.clip_components(shipped(spark, d), "clip", "path")


def component_split(spark: SparkSession, d: str) -> DataFrame:
    """Clips, components and paths of each split, and the paths that cross it, of which there are none."""
    rows = shipped(spark, d)
    made = components.component_split(rows, "clip", "path", FRACTION, SEED)
    crossing = components.crossing_paths(rows, made, "clip", "path").select(F.lit("crossing").alias("split"), F.col("path").alias("component"), F.lit(None).cast("bigint").alias("clip"))
    every = made.select("split", F.col("component").cast("string").alias("component"), "clip").unionByName(crossing)
    return every.groupBy("split").agg(F.count("clip").alias("n_clips"), F.countDistinct("component").alias("n_components"))


def rewritten(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events before and after a rewrite that paraphrases all texts, and breaks the rules here and there."""
    refs = b.references(spark, d).select("sample_id", "event_id", "ord", "type", "track_id", F.lit(None).cast("boolean").alias("verbatim"), "text", "spans")
    moved = F.transform("spans", lambda s: iv.span(s["start_ds"] + 1, s["end_ds"] + 1))
    spans, track = F.when(F.col("ord") % 17 == 3, moved).otherwise(F.col("spans")), F.when(F.col("ord") % 29 != 6, F.col("track_id"))
    after = refs.where("ord % 19 <> 4").withColumns({"spans": spans, "track_id": track, "text": F.concat(F.lit("a "), "text")})
    more = refs.where("ord % 23 = 5").withColumn("event_id", F.concat("event_id", F.lit("b")))
    return refs, after.unionByName(more).unionByName(after.where("ord % 31 = 7"))


def locked_changes(spark: SparkSession, d: str) -> DataFrame:
    return revisions.locked_changes(*rewritten(spark, d))


def base_events(spark: SparkSession, d: str) -> DataFrame:
    return b.references(spark, d).select("sample_id", "event_id", "ord", "type", "track_id", "text", F.lit(900).alias("confidence_mils"), "spans")


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """Edits of all four kinds, some events with several, and additions of any audibility."""
    e = base_events(spark, d)
    whole = F.struct("type", "track_id", "text", "confidence_mils", "spans")
    edit = lambda where, op, seq, by=0, event=None, ident=F.col("event_id"), audible=None: e.where(where).select(
        "sample_id", ident.alias("event_id"), F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(by).alias("by"), (F.lit(None).cast(revisions.EVENT) if event is None else event).alias("event"), (F.lit(None).cast("double") if audible is None else audible).alias("audibility")
    )
    rows = [
        edit("ord % 5 = 1", "SHIFT", 1, 4), edit("ord % 7 = 2", "DEGRADE", 2, 250), edit("ord % 3 = 0", "ADD", 3, 0, whole, F.concat(F.lit("X"), "event_id"), (F.col("ord") % 10) / 10.0),
    ]
    gone = e.where("ord % 11 = 3 AND ord % 5 <> 1 AND ord % 7 <> 2")
    rows.append(gone.select("sample_id", "event_id", F.lit(4).alias("seq"), F.lit("REMOVE").alias("op"), F.lit(0).alias("by"), whole.alias("event"), F.lit(None).cast("double").alias("audibility")))
    log = rows[0]
    for more in rows[1:]:
        log = log.unionByName(more)
    return revisions.gated(log, 0.3, 0.6)


def edit_targets(spark: SparkSession, d: str) -> DataFrame:
    return edit_log(spark, d).groupBy("op", "target").agg(F.count("*").alias("n"))


def flat_events(events: DataFrame) -> DataFrame:
    return events.select("sample_id", "event_id", "type", "track_id", "text", F.col("confidence_mils").cast("int").alias("confidence_mils"), *(F.get("spans", F.lit(0))[c].cast("long").alias(c) for c in ("start_ds", "end_ds")))


def edited_events(spark: SparkSession, d: str) -> DataFrame:
    return flat_events(revisions.edited(base_events(spark, d), revisions.effective(edit_log(spark, d))))


def edit_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All edits made and taken back: the events as they were."""
    log = revisions.effective(edit_log(spark, d))
    return flat_events(revisions.edited(revisions.edited(base_events(spark, d), log), revisions.inverted(log)))


def teachers(spark: SparkSession, d: str) -> DataFrame:
    """What four teachers mark: references, predictions, and each third and each second reference, moved."""
    refs, hyps = b.references(spark, d), b.predictions(spark, d)
    moved = lambda by: F.transform("spans", lambda s: iv.span(s["start_ds"] + by, s["end_ds"] + by))
    side = lambda df, name, spans="spans": df.select("sample_id", "type", F.lit(name).alias("teacher"), (F.col(spans) if isinstance(spans, str) else spans).alias("spans"))
    rows = side(refs, "sed").unionByName(side(hyps, "text")).unionByName(side(refs.where("ord % 3 = 0"), "stem", moved(5)))
    return rows.unionByName(side(refs.where("ord % 2 = 0"), "visual", moved(-2)))


def supported_spans(spark: SparkSession, d: str) -> DataFrame:
    """Times that two audio teachers support; the visual one adds to the support only."""
    found = revisions.supported_spans(teachers(spark, d), 2, voters=("sed", "text", "stem"))
    return found.select("sample_id", "type", F.col("start_ds").cast("int").alias("start_ds"), F.col("end_ds").cast("int").alias("end_ds"), "support")


def filled_quotas(spark: SparkSession, d: str) -> DataFrame:
    return dataset.fill_quotas(b.table(spark, d, "documents").select("doc_id", "lang"), "lang", QUOTAS, "doc_id", "quota-1")


QUERIES = {f.__name__: f for f in (source_components, component_split, locked_changes, edit_targets, edited_events, edit_round_trip, supported_spans, filled_quotas)}

UNIT = "CAST(('0x' || substr(md5('{0}:' || {1}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
LABELLED = """pairs AS (SELECT DISTINCT l_orderkey AS clip, l_suppkey || '/' || strftime(l_shipdate, '%Y-%m-%d') AS path FROM lineitem),
links AS (SELECT DISTINCT a.clip AS u, z.clip AS v FROM pairs a JOIN pairs z ON a.path = z.path AND a.clip <> z.clip),
known (u, c) USING KEY (u) AS (SELECT DISTINCT clip, clip FROM pairs UNION SELECT l.v, min(k.c) FROM known k JOIN links l ON l.u = k.u JOIN recurring.known r ON r.u = l.v WHERE k.c < r.c GROUP BY l.v)"""
CHANGED = f"""WITH {sql.REFS},
old AS (SELECT sample_id, event_id, type, track_id, start_ds || '-' || end_ds AS spans FROM refs),
after AS (SELECT sample_id, event_id, ord, type, CASE WHEN ord % 29 <> 6 THEN track_id END AS track_id, CASE WHEN ord % 17 = 3 THEN (start_ds + 1) || '-' || (end_ds + 1) ELSE start_ds || '-' || end_ds END AS spans FROM refs WHERE ord % 19 <> 4),
new AS (SELECT * EXCLUDE (ord) FROM after UNION ALL SELECT sample_id, event_id || 'b', type, track_id, start_ds || '-' || end_ds FROM refs WHERE ord % 23 = 5 UNION ALL SELECT * EXCLUDE (ord) FROM after WHERE ord % 31 = 7),
once AS (SELECT sample_id, event_id, count(*) AS n, any_value(type) AS type, any_value(track_id) AS track_id, any_value(spans) AS spans FROM new GROUP BY ALL),
met AS (SELECT coalesce(o.sample_id, n.sample_id) AS sample_id, coalesce(o.event_id, n.event_id) AS event_id, o.event_id IS NULL AS is_new, n.event_id IS NULL AS is_lost, n.n, o.type AS t0, n.type AS t1, o.track_id AS k0, n.track_id AS k1, o.spans AS s0, n.spans AS s1
  FROM old o FULL JOIN once n ON o.sample_id = n.sample_id AND o.event_id = n.event_id),
same AS (SELECT * FROM met WHERE NOT is_new AND NOT is_lost AND n = 1)
SELECT sample_id, event_id, 'events' AS path, NULL::VARCHAR AS before, NULL::VARCHAR AS after, CASE WHEN is_new THEN 'new_event' WHEN is_lost THEN 'lost_event' ELSE 'repeated_event' END AS rule FROM met WHERE is_new OR is_lost OR n > 1
UNION ALL SELECT sample_id, event_id, 'events.type', t0, t1, 'changed_field' FROM same WHERE t0 IS DISTINCT FROM t1
UNION ALL SELECT sample_id, event_id, 'events.track_id', k0, k1, 'changed_field' FROM same WHERE k0 IS DISTINCT FROM k1
UNION ALL SELECT sample_id, event_id, 'events.spans', s0, s1, 'changed_field' FROM same WHERE s0 IS DISTINCT FROM s1"""
EVENTS = "sample_id, event_id, type, track_id, text, {0} AS confidence_mils, {1} AS start_ds, {2} AS end_ds"
VOTED = f"""WITH {sql.BOTH},
marks AS (SELECT sample_id, type, 'sed' AS teacher, start_ds AS a, end_ds AS z FROM refs UNION ALL SELECT sample_id, type, 'text', start_ds, end_ds FROM hyps
  UNION ALL SELECT sample_id, type, 'stem', start_ds + 5, end_ds + 5 FROM refs WHERE ord % 3 = 0 UNION ALL SELECT sample_id, type, 'visual', start_ds - 2, end_ds - 2 FROM refs WHERE ord % 2 = 0),
tenths AS (SELECT DISTINCT sample_id, type, teacher, unnest(range(a, z)) AS f FROM marks),
votes AS (SELECT sample_id, type, f, count(*) AS support FROM tenths GROUP BY ALL HAVING count(*) FILTER (teacher <> 'visual') >= 2),
runs AS (SELECT *, f - row_number() OVER (PARTITION BY sample_id, type ORDER BY f) AS run FROM votes)
SELECT sample_id, type, CAST(min(f) AS INT) AS start_ds, CAST(max(f) + 1 AS INT) AS end_ds, max(support) AS support FROM runs GROUP BY sample_id, type, run"""
ORACLES = {
    "source_components": f"WITH RECURSIVE {LABELLED} SELECT u AS clip, c AS component FROM known",
    "component_split": f"WITH RECURSIVE {LABELLED}, split AS (SELECT u, c, CASE WHEN {UNIT.format(SEED, 'c')} < {FRACTION}::DOUBLE THEN 'val' ELSE 'train' END AS split FROM known) SELECT split, count(*) AS n_clips, count(DISTINCT c) AS n_components FROM split GROUP BY ALL",
    "locked_changes": CHANGED,
    "edit_targets": f"WITH {sql.REFS}, log AS (SELECT 'SHIFT' AS op, 'must_edit' AS target FROM refs WHERE ord % 5 = 1 UNION ALL SELECT 'DEGRADE', 'must_edit' FROM refs WHERE ord % 7 = 2 UNION ALL SELECT 'REMOVE', 'must_edit' FROM refs WHERE ord % 11 = 3 AND ord % 5 <> 1 AND ord % 7 <> 2 "
    "UNION ALL SELECT 'ADD', CASE WHEN ord % 10 < 3 THEN 'must_not_add' WHEN ord % 10 > 6 THEN 'must_add' ELSE 'ignore' END FROM refs WHERE ord % 3 = 0) SELECT op, target, count(*) AS n FROM log GROUP BY ALL",
    "edited_events": f"WITH {sql.REFS} SELECT {EVENTS.format('CASE WHEN ord % 7 = 2 THEN 650 ELSE 900 END', 'start_ds + CASE WHEN ord % 5 = 1 THEN 4 ELSE 0 END', 'end_ds + CASE WHEN ord % 5 = 1 THEN 4 ELSE 0 END')} FROM refs WHERE NOT (ord % 11 = 3 AND ord % 5 <> 1 AND ord % 7 <> 2) "
    f"UNION ALL SELECT {EVENTS.format('900', 'start_ds', 'end_ds').replace('event_id,', chr(39) + 'X' + chr(39) + ' || event_id AS event_id,')} FROM refs WHERE ord % 3 = 0 AND ord % 10 > 6",
    "edit_round_trip": f"WITH {sql.REFS} SELECT {EVENTS.format('900', 'start_ds', 'end_ds')} FROM refs",
    "supported_spans": VOTED,
    "filled_quotas": f"SELECT doc_id, lang FROM documents JOIN (SELECT unnest({list(QUOTAS)}) AS lang, unnest({list(QUOTAS.values())}) AS quota) USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {UNIT.format('quota-1', 'doc_id')}) <= any_value(quota) OVER (PARTITION BY lang)",
}
