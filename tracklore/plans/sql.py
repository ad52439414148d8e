"""DuckDB SQL of the same derived tables, as common table expressions."""

BASE = """
base AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS sample_id, event_id, event_type AS text,
  CASE event_type WHEN 'click' THEN 'sfx' WHEN 'view' THEN 'music' WHEN 'purchase' THEN 'speech' WHEN 'signup' THEN 'lys' ELSE 'sfx' END AS type,
  (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 288 AS start_ds, 1 + CAST(round(value * 100) AS BIGINT) % 50 AS len FROM events),
based AS (SELECT sample_id, event_id, text, type, start_ds, least(300, start_ds + len) AS end_ds FROM base)"""

REFS = BASE + """,
refs AS (SELECT sample_id, 'E' || event_id AS event_id, event_id AS ord, type, text, start_ds, end_ds,
  CASE type WHEN 'speech' THEN 'T1' WHEN 'lys' THEN 'T2' WHEN 'music' THEN 'T3' ELSE 'T4' END AS track_id FROM based)"""

BOTH = REFS + """,
moved AS (SELECT sample_id, event_id, text, CASE WHEN event_id % 11 = 5 THEN 'sfx' ELSE type END AS type, greatest(0, start_ds + event_id % 7 - 3) AS start_ds, end_ds
  FROM based WHERE event_id % 10 <> 3),
hyp0 AS (SELECT sample_id, event_id, text, type, start_ds, greatest(start_ds + 1, end_ds) AS end_ds FROM moved
  UNION ALL SELECT sample_id, event_id + 1000000000, text, type, (start_ds + 100) % 290, (start_ds + 100) % 290 + 10 FROM based WHERE event_id % 13 = 0),
hyps AS (SELECT sample_id, 'E' || event_id AS event_id, event_id AS ord, type, text, start_ds, end_ds,
  CASE type WHEN 'speech' THEN 'T1' WHEN 'lys' THEN 'T2' WHEN 'music' THEN 'T3' ELSE 'T4' END AS track_id FROM hyp0)"""

PAIRS = BOTH + """,
cand AS (SELECT r.sample_id, r.type, r.event_id AS ref_event_id, h.event_id AS hyp_event_id, r.start_ds AS rs, r.end_ds AS re, h.start_ds AS hs, h.end_ds AS he,
  least(r.end_ds, h.end_ds) - greatest(r.start_ds, h.start_ds) AS i, r.text AS rt, h.text AS ht, r.track_id IS NOT DISTINCT FROM h.track_id AS track_match
  FROM refs r JOIN hyps h ON r.sample_id = h.sample_id AND r.type = h.type AND r.start_ds < h.end_ds AND h.start_ds < r.end_ds),
pairs AS (SELECT *, round(CAST(i AS DOUBLE) / ((re - rs) + (he - hs) - i), 6) AS tiou FROM cand WHERE round(CAST(i AS DOUBLE) / ((re - rs) + (he - hs) - i), 6) >= 0.3),
alone AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sample_id, type, ref_event_id) AS nr, count(*) OVER (PARTITION BY sample_id, type, hyp_event_id) AS nh FROM pairs) WHERE nr = 1 AND nh = 1)"""


# All matchings of each block of contested pairs, reference by reference; the one with the most pairs, then the least cost in
# millionths, then the least sum of the ids' hashes wins.
MATCHED = PAIRS + """,
costed AS (SELECT *, (1 - tiou) + 0.3::DOUBLE * (CASE WHEN lower(rt) = lower(ht) THEN 0 ELSE 1 END) + CASE WHEN track_match THEN 0 ELSE 0.1::DOUBLE END AS cost FROM pairs),
hard AS (SELECT *, CAST(round(cost * 1000000) AS BIGINT) * 1048576 + CAST(('0x' || substr(md5(sample_id || '/' || type || '/' || ref_event_id || '/' || hyp_event_id), 1, 5)) AS BIGINT) AS units,
  dense_rank() OVER (PARTITION BY sample_id, type ORDER BY ref_event_id) AS k FROM costed ANTI JOIN alone USING (sample_id, type, ref_event_id, hyp_event_id)),
tries AS (SELECT DISTINCT sample_id, type, 0::BIGINT AS k, []::VARCHAR[] AS used, []::VARCHAR[] AS taken, 0::BIGINT AS units FROM hard
  UNION ALL SELECT t.sample_id, t.type, t.k + 1, CASE WHEN o.h IS NULL THEN t.used ELSE list_append(t.used, o.h) END, list_append(t.taken, o.h), t.units + o.units
  FROM tries t JOIN (SELECT sample_id, type, k, hyp_event_id AS h, units FROM hard UNION ALL SELECT DISTINCT sample_id, type, k, NULL, 0 FROM hard) o
  ON o.sample_id = t.sample_id AND o.type = t.type AND o.k = t.k + 1 AND NOT coalesce(list_contains(t.used, o.h), false)),
best AS (SELECT * FROM tries JOIN (SELECT sample_id, type, max(k) AS k FROM hard GROUP BY ALL) USING (sample_id, type, k) QUALIFY row_number() OVER (PARTITION BY sample_id, type ORDER BY len(used) DESC, units) = 1),
won AS (SELECT sample_id, type, unnest(range(1, k + 1)) AS k, unnest(taken) AS hyp_event_id FROM best),
matched AS (SELECT c.* FROM costed c SEMI JOIN alone USING (sample_id, type, ref_event_id, hyp_event_id) UNION ALL SELECT c.* EXCLUDE (units, k) FROM hard c JOIN won USING (sample_id, type, k, hyp_event_id))"""


def islands(source: str, by: str, gap: int) -> str:
    """Spans of `source` merged per `by`: those that overlap, or are less than `gap` apart."""
    return f"""
ends_{source} AS (SELECT {by}, start_ds, end_ds, max(end_ds) OVER (PARTITION BY {by} ORDER BY start_ds, end_ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
numbered_{source} AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ds - before >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY start_ds, end_ds ROWS UNBOUNDED PRECEDING) AS island FROM ends_{source}),
merged_{source} AS (SELECT {by}, island, min(start_ds) AS start_ds, max(end_ds) AS end_ds FROM numbered_{source} GROUP BY ALL)"""


FRAMES = BOTH + """,
rf AS (SELECT DISTINCT sample_id, type, unnest(range(start_ds, end_ds)) AS f FROM refs),
hf AS (SELECT DISTINCT sample_id, type, unnest(range(start_ds, end_ds)) AS f FROM hyps),
seg AS (SELECT coalesce(rf.sample_id, hf.sample_id) AS sample_id, coalesce(rf.type, hf.type) AS type,
  count(*) FILTER (rf.f IS NOT NULL AND hf.f IS NOT NULL) AS tp, count(*) FILTER (rf.f IS NULL) AS fp, count(*) FILTER (hf.f IS NULL) AS fn
  FROM rf FULL JOIN hf ON rf.sample_id = hf.sample_id AND rf.type = hf.type AND rf.f = hf.f GROUP BY ALL),
segs AS (SELECT sample_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM seg GROUP BY ALL),
segp AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / CAST(tp + fp AS DOUBLE) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM segs),
segf AS (SELECT sample_id, tp, fp, fn, round(p, 6) AS seg_precision, round(r, 6) AS seg_recall, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS seg_f1_100ms FROM segp)"""

ERRORS = """
berr AS (SELECT sample_id, count(*) AS n_matched, round(avg(abs(rs - hs)) / 10, 6) AS onset_mae, round(avg(abs(re - he)) / 10, 6) AS offset_mae,
  round(quantile_cont(abs(rs - hs)::DOUBLE, 0.9) / 10, 6) AS onset_p90, round(quantile_cont(abs(re - he)::DOUBLE, 0.9) / 10, 6) AS offset_p90,
  round(avg((abs(rs - hs) <= 1 AND abs(re - he) <= 1)::INT), 6) AS tolerance_acc_010, round(avg((abs(rs - hs) <= 2 AND abs(re - he) <= 2)::INT), 6) AS tolerance_acc_025,
  round(avg((abs(rs - hs) <= 5 AND abs(re - he) <= 5)::INT), 6) AS tolerance_acc_050, round(avg((abs(rs - hs) <= 10 AND abs(re - he) <= 10)::INT), 6) AS tolerance_acc_100,
  round(avg(track_match::INT), 6) AS pointer_accuracy FROM matched GROUP BY ALL)"""

SAMPLES = FRAMES + "," + MATCHED[len(BOTH) + 1 :] + "," + ERRORS + """,
counts AS (SELECT r.sample_id, n_ref, coalesce(n_hyp, 0) AS n_hyp, coalesce(n_matched, 0) AS n_matched, h.sample_id IS NOT NULL AS has_prediction, rt, coalesce(ht, 0) AS ht,
  seg_f1_100ms, onset_mae, offset_mae, onset_p90, offset_p90, tolerance_acc_010, tolerance_acc_025, tolerance_acc_050, tolerance_acc_100, pointer_accuracy
  FROM (SELECT sample_id, count(*) AS n_ref, count(DISTINCT track_id) AS rt FROM refs GROUP BY ALL) r
  LEFT JOIN (SELECT sample_id, count(*) AS n_hyp, count(DISTINCT track_id) AS ht FROM hyps GROUP BY ALL) h ON r.sample_id = h.sample_id
  LEFT JOIN segf s ON r.sample_id = s.sample_id LEFT JOIN berr b ON r.sample_id = b.sample_id),
shares AS (SELECT *, CASE WHEN n_hyp = 0 THEN 1.0::DOUBLE ELSE n_matched / CAST(n_hyp AS DOUBLE) END AS p, n_matched / CAST(n_ref AS DOUBLE) AS r FROM counts),
samples AS (SELECT sample_id, has_prediction, n_ref, n_hyp, n_matched,
  CASE WHEN has_prediction THEN round(p, 6) ELSE 0 END AS event_precision, CASE WHEN has_prediction THEN round(r, 6) ELSE 0 END AS event_recall,
  CASE WHEN has_prediction AND p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0 END AS event_f1, CASE WHEN has_prediction THEN coalesce(seg_f1_100ms, 1) ELSE 0 END AS seg_f1_100ms,
  CASE WHEN has_prediction THEN coalesce(onset_mae, 0) ELSE 0 END AS onset_mae, CASE WHEN has_prediction THEN coalesce(offset_mae, 0) ELSE 0 END AS offset_mae,
  CASE WHEN has_prediction THEN coalesce(onset_p90, 0) ELSE 0 END AS onset_p90, CASE WHEN has_prediction THEN coalesce(offset_p90, 0) ELSE 0 END AS offset_p90,
  CASE WHEN has_prediction THEN coalesce(tolerance_acc_010, 1) ELSE 0 END AS tolerance_acc_010, CASE WHEN has_prediction THEN coalesce(tolerance_acc_025, 1) ELSE 0 END AS tolerance_acc_025,
  CASE WHEN has_prediction THEN coalesce(tolerance_acc_050, 1) ELSE 0 END AS tolerance_acc_050, CASE WHEN has_prediction THEN coalesce(tolerance_acc_100, 1) ELSE 0 END AS tolerance_acc_100,
  n_hyp - n_matched AS hallucination, n_ref - n_matched AS omission, CAST(abs(rt - ht) AS DOUBLE) AS source_count_mae,
  CASE WHEN has_prediction THEN coalesce(pointer_accuracy, 1) ELSE 0 END AS pointer_accuracy FROM shares)"""
