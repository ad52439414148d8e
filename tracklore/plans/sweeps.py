"""Queries that evaluate at several thresholds and collars, and with soft matches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, sweep
from . import bindings as b
from . import sql
from .evaluation import both

#: The thresholds that are swept.
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40]


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References, and predictions whose confidence follows from their id."""
    refs, hyps = both(spark, d)
    return refs, hyps.withColumn("confidence", (F.col("ord") * 37 % 50) / 100.0)


def threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    refs, hyps = scored(spark, d)
    return sweep.threshold_metrics(b.clips(refs), refs, hyps, b.clips(hyps), THRESHOLDS)


def threshold_corpus(spark: SparkSession, d: str) -> DataFrame:
    return sweep.corpus_by_threshold(threshold_metrics(spark, d))


def collar_event_f1(spark: SparkSession, d: str) -> DataFrame:
    refs, hyps = both(spark, d)
    return sweep.collar_f1(b.clips(refs), refs, hyps)


def soft_event_f1(spark: SparkSession, d: str) -> DataFrame:
    refs, hyps = both(spark, d)
    return sweep.soft_f1(b.clips(refs), refs, hyps, alpha=1.0, beta=2.0)


QUERIES = {f.__name__: f for f in (threshold_metrics, threshold_corpus, collar_event_f1, soft_event_f1)}

# The evaluation of clips, where each clip stands once per threshold: its id has the threshold's number behind an @.
LEVELS = "levels AS (SELECT unnest(range(0, 7)) AS lv, unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4]::DOUBLE[]) AS threshold)"
REPEATED = sql.BOTH.replace("refs AS (", "refs0 AS (").replace("hyps AS (", "hyps0 AS (") + f""",
{LEVELS},
refs AS (SELECT sample_id || '@' || lv AS sample_id, * EXCLUDE (sample_id, lv, threshold) FROM refs0, levels),
hyps AS (SELECT sample_id || '@' || lv AS sample_id, * EXCLUDE (sample_id, lv, threshold) FROM hyps0, levels WHERE (ord * 37 % 50) / 100.0::DOUBLE >= threshold)"""
SWEPT = (
    (REPEATED + sql.SAMPLES[len(sql.BOTH) :])
    .replace("md5(sample_id ||", "md5(split_part(sample_id, '@', 1) ||")
    .replace("h.sample_id IS NOT NULL AS has_prediction", "split_part(r.sample_id, '@', 1) IN (SELECT sample_id FROM hyps0) AS has_prediction")
)
SWEPT = f"WITH RECURSIVE {SWEPT}, swept AS (SELECT threshold, s.* REPLACE (split_part(s.sample_id, '@', 1) AS sample_id) FROM samples s JOIN levels l ON l.lv = CAST(split_part(s.sample_id, '@', 2) AS INT))"

# Both times of a type side by side, the earlier one passed over if the two are too far apart.
COLLARED = f"""WITH RECURSIVE {sql.BOTH},
collars AS (SELECT unnest(['010', '025', '050', '100']) AS collar, unnest([1, 2, 5, 10]) AS k),
lists AS (SELECT sample_id, type, coalesce(list(onset ORDER BY onset) FILTER (ref), []) AS r, coalesce(list(onset ORDER BY onset) FILTER (NOT ref), []) AS h
  FROM (SELECT sample_id, type, start_ds AS onset, true AS ref FROM refs UNION ALL SELECT sample_id, type, start_ds, false FROM hyps) GROUP BY ALL),
walk AS (SELECT sample_id, type, collar, k, r, h, 1 AS i, 1 AS j, 0 AS n FROM lists, collars
  UNION ALL SELECT sample_id, type, collar, k, r, h, CASE WHEN abs(r[i] - h[j]) <= k OR r[i] < h[j] THEN i + 1 ELSE i END, CASE WHEN abs(r[i] - h[j]) <= k OR r[i] >= h[j] THEN j + 1 ELSE j END,
  n + CASE WHEN abs(r[i] - h[j]) <= k THEN 1 ELSE 0 END FROM walk WHERE i <= len(r) AND j <= len(h)),
types AS (SELECT sample_id, type, collar, max(n) AS tp, any_value(len(r)) AS n_ref, any_value(len(h)) AS n_hyp FROM walk GROUP BY ALL),
tps AS (SELECT sample_id, collar, sum(tp)::BIGINT AS tp, sum(n_ref)::BIGINT AS n_ref, sum(n_hyp)::BIGINT AS n_hyp FROM types WHERE sample_id IN (SELECT sample_id FROM refs) GROUP BY ALL),
shares AS (SELECT *, CASE WHEN n_hyp = 0 THEN 1.0::DOUBLE ELSE tp / CAST(n_hyp AS DOUBLE) END AS p, CASE WHEN n_ref = 0 THEN 1.0::DOUBLE ELSE tp / CAST(n_ref AS DOUBLE) END AS q FROM tps)
SELECT sample_id, collar, tp, n_ref, n_hyp, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0::DOUBLE ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM shares"""

# All matchings of each block of overlapping events, reference by reference; the greatest sum of weights wins.
SOFT = f"""WITH RECURSIVE {sql.BOTH},
cand AS (SELECT r.sample_id, r.type, r.event_id AS ref_event_id, h.event_id AS hyp_event_id, least(r.end_ds, h.end_ds) - greatest(r.start_ds, h.start_ds) AS i, (r.end_ds - r.start_ds) + (h.end_ds - h.start_ds) AS both_ds, lower(r.text) = lower(h.text) AS same
  FROM refs r JOIN hyps h ON r.sample_id = h.sample_id AND r.type = h.type AND r.start_ds < h.end_ds AND h.start_ds < r.end_ds),
weighed AS (SELECT sample_id, type, ref_event_id, hyp_event_id, CAST(round(pow(round(CAST(i AS DOUBLE) / (both_ds - i), 6), 2) * 1000000) AS BIGINT) AS w FROM cand WHERE same),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY sample_id, type ORDER BY ref_event_id) AS k FROM weighed WHERE w > 0),
tries AS (SELECT DISTINCT sample_id, type, 0::BIGINT AS k, []::VARCHAR[] AS used, 0::BIGINT AS w FROM ranked
  UNION ALL SELECT t.sample_id, t.type, t.k + 1, CASE WHEN o.h IS NULL THEN t.used ELSE list_append(t.used, o.h) END, t.w + o.w
  FROM tries t JOIN (SELECT sample_id, type, k, hyp_event_id AS h, w FROM ranked UNION ALL SELECT DISTINCT sample_id, type, k, NULL, 0 FROM ranked) o
  ON o.sample_id = t.sample_id AND o.type = t.type AND o.k = t.k + 1 AND NOT coalesce(list_contains(t.used, o.h), false)),
best AS (SELECT sample_id, sum(w)::BIGINT AS w FROM (SELECT sample_id, type, max(w) AS w FROM tries GROUP BY ALL) GROUP BY ALL),
clips AS (SELECT r.sample_id, n_ref, coalesce(n_hyp, 0) AS n_hyp, coalesce(w, 0) AS w FROM (SELECT sample_id, count(*) AS n_ref FROM refs GROUP BY ALL) r
  LEFT JOIN (SELECT sample_id, count(*) AS n_hyp FROM hyps GROUP BY ALL) h ON h.sample_id = r.sample_id LEFT JOIN best b ON b.sample_id = r.sample_id)
SELECT sample_id, w / 1000000.0::DOUBLE AS weight, n_ref, n_hyp, CASE WHEN n_hyp = 0 THEN 1.0::DOUBLE ELSE ((2 * w + n_hyp) // (2 * n_hyp)) / 1000000.0::DOUBLE END AS soft_precision, ((2 * w + n_ref) // (2 * n_ref)) / 1000000.0::DOUBLE AS soft_recall,
  ((4 * w + n_ref + n_hyp) // (2 * (n_ref + n_hyp))) / 1000000.0::DOUBLE AS soft_f1 FROM clips"""

ORACLES = {
    "threshold_metrics": f"{SWEPT} SELECT * FROM swept",
    "threshold_corpus": f"{SWEPT} SELECT threshold, count(*) AS n_samples, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in metrics.MEANS) + ", sum(hallucination)::BIGINT AS total_hallucination, sum(omission)::BIGINT AS total_omission FROM swept GROUP BY ALL",
    "collar_event_f1": COLLARED,
    "soft_event_f1": SOFT,
}
