"""Queries over intervals, matching, metrics, strata and validation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import match, metrics, validate
from . import bindings as b
from . import sql


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("sample_id", "type").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def span_rows(df: DataFrame, spans) -> DataFrame:
    return df.select("sample_id", "type", F.inline(spans)).select("sample_id", "type", F.col("start_ds").cast("long").alias("start_ds"), F.col("end_ds").cast("long").alias("end_ds"))


def span_union(spark: SparkSession, d: str) -> DataFrame:
    return span_rows(by_type(b.references(spark, d)), iv.merged(F.col("spans")))


def close_gap_merge(spark: SparkSession, d: str) -> DataFrame:
    return span_rows(by_type(b.references(spark, d)), iv.merged(F.col("spans"), 3))


def union_duration(spark: SparkSession, d: str) -> DataFrame:
    return by_type(b.references(spark, d)).select("sample_id", "type", iv.length(iv.merged(F.col("spans"))).cast("long").alias("duration_ds"))


def span_disjoint_check(spark: SparkSession, d: str) -> DataFrame:
    return by_type(b.references(spark, d)).where(~iv.disjoint(F.col("spans"))).select("sample_id", "type")


def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    per = by_type(b.references(spark, d)).groupBy("sample_id").agg(F.collect_list("spans").alias("all_"))
    return per.select("sample_id", iv.overlap_ratio(F.col("all_"), F.lit(b.CLIP_DS)).alias("overlap_ratio"))


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return b.references(spark, d), b.predictions(spark, d)


def event_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = match.candidates(*both(spark, d))
    return pairs.select("sample_id", "type", "ref_event_id", "hyp_event_id", "tiou", "text_sim", "track_match", F.round("cost", 6).alias("cost"))


def matched(spark: SparkSession, d: str) -> DataFrame:
    return match.matches(match.candidates(*both(spark, d)))


def assign_degree1(spark: SparkSession, d: str) -> DataFrame:
    return match.isolated(match.candidates(*both(spark, d))).where("alone").select("sample_id", "type", "ref_event_id", "hyp_event_id", "tiou")


def assign_full(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select("sample_id", "type", "ref_event_id", "hyp_event_id", "tiou", F.round("cost", 6).alias("cost"))


def seg_f1_sample(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.segment_f1(metrics.type_measures(*both(spark, d)))
    return s.withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn")})


def seg_f1_corpus(spark: SparkSession, d: str) -> DataFrame:
    return metrics.segment_f1(metrics.type_measures(*both(spark, d))).agg(F.count("*").alias("n"), F.round(F.avg("seg_f1_100ms"), 6).alias("macro_seg_f1_100ms"))


def boundary_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.boundary_errors(matched(spark, d)).select("sample_id", "n_matched", "onset_mae", "offset_mae", "onset_p90", "offset_p90")


def tolerance_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.boundary_errors(matched(spark, d)).select("sample_id", *(f"tolerance_acc_{t}" for t in metrics.TOLERANCES), "pointer_accuracy")


def per_type_prf(spark: SparkSession, d: str) -> DataFrame:
    refs, hyps = both(spark, d)
    return metrics.per_type(refs, hyps, matched(spark, d))


def macro_per_type(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_per_type(per_type_prf(spark, d))


def samples(spark: SparkSession, d: str) -> DataFrame:
    refs, hyps = both(spark, d)
    return metrics.sample_metrics(refs, refs, hyps, hyps)


def sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d)


def sample_metrics_full(spark: SparkSession, d: str) -> DataFrame:
    """The same with tracks counted beforehand, as ledgers with tracks that no event names give them."""
    refs, hyps = both(spark, d)
    return metrics.sample_metrics(b.clips(refs), refs, hyps, b.clips(hyps), ref_tracks=b.track_counts(refs), hyp_tracks=b.track_counts(hyps))


def corpus_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.corpus_metrics(samples(spark, d))


def missing_prediction(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).where("not has_prediction").select("sample_id", "n_ref", "event_f1", "tolerance_acc_100", "omission")


def strata_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.strata(metrics.with_buckets(samples(spark, d), b.conditions(b.references(spark, d))))


def strata_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.with_buckets(samples(spark, d), b.conditions(b.references(spark, d)))
    return spark.sql(
        "SELECT axis_template, axis_source_count, count(*) AS n, round(avg(event_f1), 6) AS event_f1 FROM {clips} "
        "GROUP BY GROUPING SETS ((axis_template), (axis_source_count), (axis_template, axis_source_count), ())",
        clips=rows,
    )


def broken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ledgers with planted violations: clips, tracks, events, relations."""
    refs = b.references(spark, d)
    events = refs.select(
        "sample_id",
        F.when(F.col("ord") % 97 == 0, F.lit("X1")).when(F.col("ord") % 89 == 0, F.lit("E7")).otherwise(F.col("event_id")).alias("event_id"),
        "ord",
        F.when(F.col("ord") % 83 == 0, F.lit("vocal")).otherwise(F.col("type")).alias("type"),
        F.when(F.col("ord") % 79 == 0, F.lit("T9")).when(F.col("ord") % 73 == 0, F.lit(None)).otherwise(F.col("track_id")).alias("track_id"),
        F.when(F.col("ord") % 71 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("ord") % 67 == 0, F.lit(1.5)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("ord") % 61 == 0, F.transform("spans", lambda s: iv.span(s["start_ds"], s["start_ds"]))).when(F.col("ord") % 59 == 0, F.transform("spans", lambda s: iv.span(s["start_ds"], s["end_ds"] + 300))).otherwise(F.col("spans")).alias("spans"),
    )
    tracks = refs.select("sample_id", "track_id", F.col("type").alias("kind"), F.lit(0.9).alias("confidence"), F.array(iv.span(F.lit(0), F.lit(b.CLIP_DS))).alias("spans")).distinct().replace("lys", "vocal", "kind")
    relations = refs.where("ord % 5 = 0").select("sample_id", "event_id", F.when(F.col("ord") % 25 == 0, "near").otherwise("before").alias("predicate"), F.when(F.col("ord") % 35 == 0, "E0x").otherwise(F.col("event_id")).alias("target_event_id"))
    return b.clips(refs), tracks, events, relations


def fk_anti(spark: SparkSession, d: str) -> DataFrame:
    _, tracks, events, _ = broken(spark, d)
    return validate.dangling_tracks(events, tracks).select("sample_id", "event_id", "track_id")


def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return validate.repeated_ids(broken(spark, d)[2], "event_id")


def duration_bounds(spark: SparkSession, d: str) -> DataFrame:
    clips, _, events, _ = broken(spark, d)
    return validate.outside_clip(events, clips).select("sample_id", "event_id")


def violation_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(validate.violations(*broken(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        span_union, close_gap_merge, union_duration, span_disjoint_check, overlap_ratio, event_iou_pairs, assign_degree1, assign_full, seg_f1_sample, seg_f1_corpus,
        boundary_errors, tolerance_accuracy, per_type_prf, macro_per_type, sample_metrics, sample_metrics_full, corpus_metrics, missing_prediction,
        strata_metrics, strata_grouping_sets, fk_anti, repeated_ids, duration_bounds, violation_summary,
    )
}

PRF = f"""WITH RECURSIVE {sql.MATCHED}, keyed AS (SELECT DISTINCT sample_id, type FROM (SELECT sample_id, type FROM refs UNION ALL SELECT sample_id, type FROM hyps)),
tps AS (SELECT k.sample_id, k.type, (SELECT count(*) FROM matched a WHERE a.sample_id = k.sample_id AND a.type = k.type) AS tp,
  (SELECT count(*) FROM refs a WHERE a.sample_id = k.sample_id AND a.type = k.type) AS nr, (SELECT count(*) FROM hyps a WHERE a.sample_id = k.sample_id AND a.type = k.type) AS nh FROM keyed k),
pr AS (SELECT *, CASE WHEN nh = 0 THEN 1.0::DOUBLE ELSE tp / CAST(nh AS DOUBLE) END AS p, CASE WHEN nr = 0 THEN 1.0::DOUBLE ELSE tp / CAST(nr AS DOUBLE) END AS r FROM tps),
prf AS (SELECT sample_id, type, tp, nh - tp AS fp, nr - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr)"""

BUCKETED = f"""WITH RECURSIVE {sql.SAMPLES},
cn AS (SELECT sample_id, count(*) AS n, count(DISTINCT track_id) AS source_count, min(type) AS template FROM refs GROUP BY ALL),
cond AS (SELECT sample_id, CASE WHEN n % 5 = 0 THEN NULL ELSE (n % 4) * 0.25::DOUBLE + 0.2::DOUBLE END AS t60_sec, (n % 6) * 0.1::DOUBLE AS overlap_ratio, 10.0::DOUBLE + (n % 5) * 4.0::DOUBLE AS duration, source_count, template,
  CASE WHEN n % 3 = 0 THEN (n % 2) * 40 END AS echo FROM cn),
bucketed AS (SELECT s.*,
  CASE WHEN t60_sec IS NULL THEN 'unknown' WHEN t60_sec < 0.3 THEN '<0.3' WHEN t60_sec < 0.6 THEN '<0.6' WHEN t60_sec < 0.9 THEN '<0.9' ELSE '>=0.9' END AS axis_t60_sec,
  CASE WHEN overlap_ratio < 0.1::DOUBLE THEN '<0.1' WHEN overlap_ratio < 0.3::DOUBLE THEN '<0.3' WHEN overlap_ratio < 0.5::DOUBLE THEN '<0.5' ELSE '>=0.5' END AS axis_overlap_ratio,
  CASE WHEN duration < 15 THEN '<15.0' WHEN duration < 20 THEN '<20.0' WHEN duration < 25 THEN '<25.0' ELSE '>=25.0' END AS axis_duration,
  CAST(source_count AS VARCHAR) AS axis_source_count, template AS axis_template, coalesce(CAST(echo AS VARCHAR), 'unknown') AS axis_echo
  FROM samples s JOIN cond c ON s.sample_id = c.sample_id)"""

MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in metrics.STRATUM_MEANS)
BROKEN = f"""WITH {sql.REFS},
ev AS (SELECT sample_id, CASE WHEN ord % 97 = 0 THEN 'X1' WHEN ord % 89 = 0 THEN 'E7' ELSE event_id END AS event_id, ord, CASE WHEN ord % 83 = 0 THEN 'vocal' ELSE type END AS type,
  CASE WHEN ord % 79 = 0 THEN 'T9' WHEN ord % 73 = 0 THEN NULL ELSE track_id END AS track_id, CASE WHEN ord % 71 = 0 THEN '' ELSE text END AS text,
  CASE WHEN ord % 67 = 0 THEN 1.5 ELSE 0.9 END AS confidence, start_ds, CASE WHEN ord % 61 = 0 THEN start_ds WHEN ord % 59 = 0 THEN end_ds + 300 ELSE end_ds END AS end_ds FROM refs),
tr AS (SELECT DISTINCT sample_id, track_id FROM refs),
re AS (SELECT sample_id, event_id, CASE WHEN ord % 25 = 0 THEN 'near' ELSE 'before' END AS predicate, CASE WHEN ord % 35 = 0 THEN 'E0x' ELSE event_id END AS target FROM refs WHERE ord % 5 = 0),
dangling AS (SELECT e.sample_id, e.event_id, e.track_id FROM ev e ANTI JOIN tr t ON e.sample_id = t.sample_id AND e.track_id = t.track_id WHERE e.track_id IS NOT NULL),
twice AS (SELECT sample_id, event_id, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1),
viol AS (SELECT sample_id, 'event_span' AS rule FROM ev WHERE end_ds <= start_ds UNION ALL SELECT sample_id, 'event_id' FROM ev WHERE NOT regexp_full_match(event_id, 'E[0-9]+')
  UNION ALL SELECT sample_id, 'event_type' FROM ev WHERE type NOT IN ('speech', 'lys', 'music', 'sfx') UNION ALL SELECT sample_id, 'event_text' FROM ev WHERE length(text) < 1
  UNION ALL SELECT sample_id, 'event_confidence' FROM ev WHERE confidence > 1 UNION ALL SELECT sample_id, 'event_repeated' FROM twice UNION ALL SELECT sample_id, 'event_track' FROM dangling
  UNION ALL SELECT sample_id, 'event_outside' FROM ev WHERE end_ds > 300 UNION ALL SELECT sample_id, 'relation_predicate' FROM re WHERE predicate = 'near'
  UNION ALL SELECT r.sample_id, 'relation_target' FROM re r ANTI JOIN ev e ON r.sample_id = e.sample_id AND r.target = e.event_id)"""

ORACLES = {
    "span_union": f"WITH {sql.REFS},{sql.islands('refs', 'sample_id, type', 0)} SELECT sample_id, type, start_ds, end_ds FROM merged_refs",
    "close_gap_merge": f"WITH {sql.REFS},{sql.islands('refs', 'sample_id, type', 3)} SELECT sample_id, type, start_ds, end_ds FROM merged_refs",
    "union_duration": f"WITH {sql.REFS},{sql.islands('refs', 'sample_id, type', 0)} SELECT sample_id, type, sum(end_ds - start_ds)::BIGINT AS duration_ds FROM merged_refs GROUP BY ALL",
    "span_disjoint_check": f"WITH {sql.REFS}, o AS (SELECT sample_id, type, start_ds < lag(end_ds) OVER (PARTITION BY sample_id, type ORDER BY start_ds, end_ds) AS bad FROM refs) SELECT DISTINCT sample_id, type FROM o WHERE bad",
    "overlap_ratio": f"WITH {sql.REFS}, f AS (SELECT DISTINCT sample_id, type, unnest(range(start_ds, end_ds)) AS f FROM refs), n AS (SELECT sample_id, f, count(*) AS k FROM f GROUP BY ALL) "
    "SELECT sample_id, round(count(*) FILTER (k >= 2) / 300.0::DOUBLE, 6) AS overlap_ratio FROM n GROUP BY ALL",
    "event_iou_pairs": f"WITH {sql.PAIRS} SELECT sample_id, type, ref_event_id, hyp_event_id, tiou, CASE WHEN lower(rt) = lower(ht) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS text_sim, track_match, "
    "round((1 - tiou) + 0.3::DOUBLE * (CASE WHEN lower(rt) = lower(ht) THEN 0 ELSE 1 END) + CASE WHEN track_match THEN 0 ELSE 0.1::DOUBLE END, 6) AS cost FROM pairs",
    "assign_degree1": f"WITH {sql.PAIRS} SELECT sample_id, type, ref_event_id, hyp_event_id, tiou FROM alone",
    "assign_full": f"WITH RECURSIVE {sql.MATCHED} SELECT sample_id, type, ref_event_id, hyp_event_id, tiou, round(cost, 6) AS cost FROM matched",
    "seg_f1_sample": f"WITH {sql.FRAMES} SELECT * FROM segf",
    "seg_f1_corpus": f"WITH {sql.FRAMES} SELECT count(*) AS n, round(avg(seg_f1_100ms), 6) AS macro_seg_f1_100ms FROM segf",
    "boundary_errors": f"WITH RECURSIVE {sql.MATCHED},{sql.ERRORS} SELECT sample_id, n_matched, onset_mae, offset_mae, onset_p90, offset_p90 FROM berr",
    "tolerance_accuracy": f"WITH RECURSIVE {sql.MATCHED},{sql.ERRORS} SELECT sample_id, tolerance_acc_010, tolerance_acc_025, tolerance_acc_050, tolerance_acc_100, pointer_accuracy FROM berr",
    "per_type_prf": f"{PRF} SELECT * FROM prf",
    "macro_per_type": f"{PRF} SELECT type, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM prf GROUP BY ALL",
    "sample_metrics": f"WITH RECURSIVE {sql.SAMPLES} SELECT * FROM samples",
    "sample_metrics_full": f"WITH RECURSIVE {sql.SAMPLES} SELECT * FROM samples",
    "corpus_metrics": f"WITH RECURSIVE {sql.SAMPLES} SELECT count(*) AS n_samples, round(avg(has_prediction::INT), 6) AS strict_format_success_rate, "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in metrics.MEANS)
    + ", sum(hallucination)::BIGINT AS total_hallucination, sum(omission)::BIGINT AS total_omission FROM samples",
    "missing_prediction": f"WITH RECURSIVE {sql.SAMPLES} SELECT sample_id, n_ref, event_f1, tolerance_acc_100, omission FROM samples WHERE NOT has_prediction",
    "strata_metrics": BUCKETED + " " + " UNION ALL ".join(f"SELECT '{a}' AS axis, axis_{a} AS bucket, count(*) AS n, {MEANS}, sum(hallucination)::BIGINT AS hallucination, sum(omission)::BIGINT AS omission FROM bucketed GROUP BY ALL" for a in metrics.AXES),
    "strata_grouping_sets": BUCKETED + " SELECT axis_template, axis_source_count, count(*) AS n, round(avg(event_f1), 6) AS event_f1 FROM bucketed GROUP BY GROUPING SETS ((axis_template), (axis_source_count), (axis_template, axis_source_count), ())",
    "fk_anti": f"{BROKEN} SELECT * FROM dangling",
    "repeated_ids": f"{BROKEN} SELECT * FROM twice",
    "duration_bounds": f"{BROKEN} SELECT sample_id, event_id FROM ev WHERE end_ds > 300",
    "violation_summary": f"{BROKEN} SELECT rule, count(*) AS n, count(DISTINCT sample_id) AS n_clips FROM viol GROUP BY ALL",
}
