"""Queries over the uncertainty of metrics and the calibration of confidences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, uncertainty
from . import sql
from .evaluation import samples
from .sweeps import SWEPT, scored, threshold_metrics

RATED = ["event_f1", "seg_f1_100ms", "onset_mae", "hallucination"]
REPLICATES, FLIPS = 100, 200


def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    return uncertainty.bootstrap(samples(spark, d), RATED, REPLICATES)


def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    """Event F1 with the predictions from one threshold on against those from a higher one on."""
    swept = threshold_metrics(spark, d)
    of = lambda t: F.max(F.when(F.col("threshold") == t, F.col("event_f1")))
    return uncertainty.paired_permutation(swept.groupBy("sample_id").agg(of(0.2).alias("a"), of(0.25).alias("b")), "a", "b", FLIPS)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with their confidence and whether they match a reference."""
    refs, hyps = scored(spark, d)
    found = match.matches(match.candidates(refs, hyps)).select("sample_id", F.col("hyp_event_id").alias("event_id"), F.lit(True).alias("hit"))
    rows = hyps.join(found, ["sample_id", "event_id"], "left")
    return rows.select("sample_id", "event_id", "confidence", F.col("hit").isNotNull().alias("correct"))


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return uncertainty.calibration_bins(judged(spark, d))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return uncertainty.calibration(judged(spark, d))


def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return uncertainty.risk_coverage(judged(spark, d))


QUERIES = {f.__name__: f for f in (bootstrap_intervals, permutation_test, calibration_bins, calibration, risk_coverage)}

DRAW = "CAST(('0x' || substr(md5('1/' || b || '/' || sample_id), 1, 8)) AS BIGINT)"
POISSON = " + ".join(f"(u >= {step})::INT" for step in uncertainty.poisson_steps())
JUDGED = f"""WITH RECURSIVE {sql.MATCHED},
judged AS (SELECT h.sample_id, h.event_id, (h.ord * 37 % 50) * 10000 AS units, (m.hyp_event_id IS NOT NULL)::INT AS good FROM hyps h LEFT JOIN matched m ON m.sample_id = h.sample_id AND m.hyp_event_id = h.event_id),
each AS (SELECT units, count(*) AS n, sum(good)::BIGINT AS good FROM judged GROUP BY ALL),
run AS (SELECT *, coalesce(sum(n) OVER (ORDER BY units ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before, coalesce(sum(good) OVER (ORDER BY units ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS good_before,
  sum(n) OVER ()::BIGINT AS n_all, sum(good) OVER ()::BIGINT AS good_all FROM each),
binned AS (SELECT CAST(n_before * 10 // n_all AS INT) AS bin, sum(n)::BIGINT AS n, sum(units * n) / sum(n) / 1000000.0::DOUBLE AS c, sum(good) / sum(n) AS a FROM run GROUP BY ALL),
bins AS (SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy, round(abs(a - c), 6) AS gap FROM binned)"""
ORACLES = {
    "bootstrap_intervals": f"WITH RECURSIVE {sql.SAMPLES}, "
    + "long AS ("
    + " UNION ALL ".join(f"SELECT sample_id, '{m}' AS metric, CAST(round({m} * 1000000) AS BIGINT) AS v FROM samples" for m in RATED)
    + f"), drawn AS (SELECT *, {DRAW} AS u FROM long, range(0, {REPLICATES + 1}) AS bs(b)), weighed AS (SELECT metric, b, v, CASE WHEN b = 0 THEN 1 ELSE {POISSON} END AS w FROM drawn), "
    "means AS (SELECT metric, b, sum(w)::BIGINT AS n, sum(w * v) / sum(w) / 1000000.0::DOUBLE AS mean FROM weighed GROUP BY ALL) "
    "SELECT metric, max(n) FILTER (b = 0) AS n, round(max(mean) FILTER (b = 0), 6) AS mean, round(quantile_cont(mean, 0.025) FILTER (b > 0), 6) AS low, round(quantile_cont(mean, 0.975) FILTER (b > 0), 6) AS high FROM means GROUP BY metric",
    "permutation_test": f"{SWEPT}, d AS (SELECT sample_id, CAST(round(max(event_f1) FILTER (threshold = 0.2) * 1000000) AS BIGINT) - CAST(round(max(event_f1) FILTER (threshold = 0.25) * 1000000) AS BIGINT) AS d FROM swept GROUP BY sample_id), "
    f"sums AS (SELECT b, sum(CASE WHEN b = 0 OR {DRAW} % 2 = 0 THEN d ELSE -d END)::BIGINT AS s, count(*) AS n FROM d, range(0, {FLIPS + 1}) AS bs(b) GROUP BY b), own AS (SELECT s, n FROM sums WHERE b = 0) "
    f"SELECT any_value(own.n) AS n, round(any_value(own.s) / any_value(own.n) / 1000000.0::DOUBLE, 6) AS mean_difference, count(*) FILTER (abs(sums.s) >= abs(own.s)) AS at_least, round((count(*) FILTER (abs(sums.s) >= abs(own.s)) + 1) / {FLIPS + 1}.0::DOUBLE, 6) AS p_value FROM sums, own WHERE b > 0",
    "calibration_bins": f"{JUDGED} SELECT * FROM bins",
    "calibration": f"{JUDGED} SELECT sum(n)::BIGINT AS n, round(sum(n * gap) / sum(n), 6) AS ece, max(gap) AS max_gap, (SELECT round(avg(pow(units / 1000000.0::DOUBLE - good, 2)), 6) FROM judged) AS brier FROM bins",
    "risk_coverage": f"{JUDGED} SELECT round(units / 1000000.0::DOUBLE, 6) AS confidence, n_all - n_before AS n, round((n_all - n_before) / CAST(n_all AS DOUBLE), 6) AS coverage, round(((n_all - n_before) - (good_all - good_before)) / CAST(n_all - n_before AS DOUBLE), 6) AS risk FROM run",
}
