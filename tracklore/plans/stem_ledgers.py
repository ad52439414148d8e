"""Queries over stems, built ledgers' conditions and held-out reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import building, stems
from . import bindings as b
from . import building as built
from . import captions, signals, sql

STEMS = ("vocals", "drums", "piano", "noise")


def rows_of(events: DataFrame) -> DataFrame:
    return events.select("sample_id", "event_id", "type", "text", "confidence", iv.onset(F.col("spans")).cast("long").alias("start_ds"), iv.offset(F.col("spans")).cast("long").alias("end_ds"), F.size("spans").cast("long").alias("n_spans"))


def stem_ledgers(spark: SparkSession, d: str) -> DataFrame:
    """Four vectors are the stems of a clip; each third has a caption."""
    v = F.col("vec_id")
    rows = b.waves(spark, d).select(F.floor(v / 4).cast("string").alias("sample_id"), (v % 4).alias("pos"), F.element_at(F.array(*map(F.lit, STEMS)), (v % 4 + 1).cast("int")).alias("stem"), "wave", F.when(v % 3 == 0, F.concat(F.lit("heard in "), v.cast("string"))).alias("caption"))
    return rows_of(stems.stem_events(rows, signals.HOP, signals.FRAMES, threshold=0.5))


def oracle_ledgers(spark: SparkSession, d: str) -> DataFrame:
    """Sources of a clip: its types, and one of a kind that it may not have."""
    refs = b.references(spark, d)
    kinds = refs.select("sample_id", "type").distinct().withColumn("kind", F.when(F.col("type") == "lys", "vocal").otherwise(F.col("type")))
    own = kinds.select("sample_id", F.col("kind"), F.lit(None).cast("string").alias("caption"))
    more = kinds.select("sample_id").distinct().select("sample_id", F.lit("music").alias("kind"), F.lit("a tune").alias("caption"))
    rows = own.unionByName(more).select("sample_id", F.concat_ws("/", "kind", "caption").alias("pos"), "kind", F.lit(290).alias("onset_ds"), F.lit(b.CLIP_DS).alias("duration_ds"), F.lit(None).cast("string").alias("text"), "caption")
    return rows_of(stems.oracle_events(rows, refs))


def ledger_conditions(spark: SparkSession, d: str) -> DataFrame:
    sources = built.placed(spark, d)
    clips = sources.select("sample_id").distinct().select("sample_id", F.lit(b.CLIP_DS).alias("duration_ds"), F.lit("day").alias("template"))
    n = F.length("sample_id")
    known = clips.where(n % 5 != 0).select("sample_id", (n * 1.5).alias("snr_db"), F.when(n % 2 == 0, n / 20.0).alias("t60_sec"), F.when(n % 3 == 0, n * 10).alias("echo_delay_ms"), F.lit("mp3").alias("codec"))
    origin = {"label_level": "model_prediction", "source_dataset": "events", "renderer_manifest_uri": None, "license_status": "synthetic"}
    made = stems.with_conditions(building.built_ledgers(clips, sources), known, origin)
    return made.select("sample_id", "conditions.*", F.col("provenance.source_dataset").alias("source_dataset"), F.col("provenance.license_status").alias("license_status"))


def held_out_review(spark: SparkSession, d: str) -> DataFrame:
    refs, hyps = b.references(spark, d), b.predictions(spark, d)
    made = stems.review_rows(b.clips(refs).select("sample_id"), refs, hyps)
    return made.withColumns({c: F.col(c).cast("long") for c in ("gt_n_events", "pred_n_events")})


def clamped_events(spark: SparkSession, d: str) -> DataFrame:
    """Predictions moved by their id, some out of the clip, and put back into it."""
    hyps = b.predictions(spark, d)
    by = (F.col("ord") % 61 * 10 - 300).cast("int")
    moved = F.transform("spans", lambda s: iv.span(s["start_ds"] + by, s["end_ds"] + by))
    kept = stems.clamped(moved, F.lit(b.CLIP_DS))
    return hyps.select("sample_id", "event_id", iv.onset(kept).cast("long").alias("start_ds"), iv.offset(kept).cast("long").alias("end_ds"))


QUERIES = {f.__name__: f for f in (stem_ledgers, oracle_ledgers, ledger_conditions, held_out_review, clamped_events)}

PLACE = "CAST({0} // 10 AS VARCHAR) || '.' || ({0} % 10)"
SHOWN = f"type || ' [' || {PLACE.format('start_ds')} || '-' || {PLACE.format('end_ds')} || '] ' || substr(text, 1, 40)"
ORACLES = {
    "stem_ledgers": f"""WITH {signals.SPANS}, loud AS (SELECT vec_id FROM x GROUP BY vec_id HAVING sqrt(sum(v * v) / 64) >= 0.005),
parts AS (SELECT s.*, row_number() OVER (PARTITION BY vec_id ORDER BY start_ds) AS part FROM spans s SEMI JOIN loud USING (vec_id) QUALIFY part <= 3)
SELECT CAST(vec_id // 4 AS VARCHAR) AS sample_id, 'E' || lpad(CAST(row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id, part) AS VARCHAR), 3, '0') AS event_id, CASE vec_id % 4 WHEN 0 THEN 'lys' ELSE 'sfx' END AS type,
CASE WHEN vec_id % 3 = 0 THEN 'heard in ' || vec_id ELSE 'stem ' || ['vocals', 'drums', 'piano', 'noise'][vec_id % 4 + 1] END AS text, 0.7::DOUBLE AS confidence, start_ds, end_ds, 1 AS n_spans FROM parts""",
    "oracle_ledgers": f"""WITH {sql.REFS}, kinds AS (SELECT DISTINCT sample_id, type FROM refs), src AS (SELECT sample_id, type, CASE type WHEN 'lys' THEN 'vocal' ELSE type END AS pos, NULL AS caption FROM kinds UNION ALL SELECT DISTINCT sample_id, 'music', 'music/a tune', 'a tune' FROM kinds),
first AS (SELECT sample_id, type, start_ds, end_ds FROM refs QUALIFY row_number() OVER (PARTITION BY sample_id, type ORDER BY start_ds, event_id) = 1)
SELECT s.sample_id, 'E' || lpad(CAST(row_number() OVER (PARTITION BY s.sample_id ORDER BY pos) AS VARCHAR), 3, '0') AS event_id, s.type, coalesce(caption, 'an event') AS text, 0.9::DOUBLE AS confidence, coalesce(start_ds, 290) AS start_ds, coalesce(end_ds, 300) AS end_ds, 1 AS n_spans FROM src s LEFT JOIN first f ON f.sample_id = s.sample_id AND f.type = s.type""",
    "ledger_conditions": f"""WITH {sql.REFS},{sql.islands('refs', 'sample_id, type', 3)},
frames AS (SELECT DISTINCT sample_id, type, unnest(range(start_ds, end_ds)) AS f FROM merged_refs), busy AS (SELECT sample_id, f, count(*) AS k FROM frames GROUP BY ALL), ratios AS (SELECT sample_id, length(sample_id) AS n, round(count(*) FILTER (k >= 2) / 300.0::DOUBLE, 6) AS overlap_ratio FROM busy GROUP BY ALL)
SELECT sample_id, 'day' AS domain, CASE WHEN n % 5 <> 0 THEN n * 1.5::DOUBLE END AS snr_db, CASE WHEN n % 5 <> 0 AND n % 2 = 0 THEN n / 20.0::DOUBLE END AS t60_sec, n % 5 <> 0 AND n % 3 = 0 AS echo, CASE WHEN n % 5 <> 0 THEN 'mp3' END AS codec, overlap_ratio, 'events' AS source_dataset, 'synthetic' AS license_status FROM ratios""",
    "held_out_review": f"""WITH {sql.BOTH}, g AS (SELECT sample_id, count(*) AS n, string_agg({SHOWN}, ' | ' ORDER BY start_ds, event_id) AS t, list(DISTINCT type || ':' || start_ds) AS k FROM refs GROUP BY ALL), p AS (SELECT sample_id, count(*) AS n, string_agg({SHOWN}, ' | ' ORDER BY start_ds, event_id) AS t, list(DISTINCT type || ':' || start_ds) AS k FROM hyps GROUP BY ALL),
j AS (SELECT g.sample_id, g.n AS gt_n_events, g.t AS gt_events, coalesce(p.n, 0) AS pred_n_events, coalesce(p.t, '(parse failed)') AS pred_events, len(g.k) AS ng, coalesce(len(p.k), 0) AS np, len(list_intersect(g.k, coalesce(p.k, []))) AS c FROM g LEFT JOIN p ON p.sample_id = g.sample_id)
SELECT sample_id, gt_n_events, gt_events, pred_n_events, pred_events, CASE WHEN np = c AND ng = c THEN 'correct' WHEN ng = c THEN 'halluc' WHEN np = c THEN 'omit' ELSE 'mixed' END AS match, 'correct=' || c || ' halluc=' || (np - c) || ' omit=' || (ng - c) AS errors FROM j""",
    "clamped_events": f"""WITH {sql.BOTH}, m AS (SELECT sample_id, event_id, greatest(0, least(start_ds + ord % 61 * 10 - 300, 299)) AS a, end_ds + ord % 61 * 10 - 300 AS z FROM hyps) SELECT sample_id, event_id, a AS start_ds, greatest(a + 1, least(z, 300)) AS end_ds FROM m""",
}
