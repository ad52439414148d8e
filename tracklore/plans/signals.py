"""Queries over waveforms (embeddings as 64 samples), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import activity as ac
from . import bindings as b

HOP, FRAMES = 4, 16


def exploded(df: DataFrame, values) -> DataFrame:
    return df.select("vec_id", F.posexplode(values).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


def frame_rms(spark: SparkSession, d: str) -> DataFrame:
    return exploded(b.waves(spark, d), ac.frame_rms(F.col("wave"), HOP))


def activity_mask(spark: SparkSession, d: str) -> DataFrame:
    rms = ac.frame_rms(F.col("wave"), HOP)
    return b.waves(spark, d).select("vec_id", F.posexplode(ac.active(rms, threshold=0.5)).alias("pos", "on")).select("vec_id", F.col("pos").cast("long").alias("pos"), "on")


def span_rows(df: DataFrame, spans) -> DataFrame:
    return df.select("vec_id", F.inline(spans)).select("vec_id", F.col("start_ds").cast("long").alias("start_ds"), F.col("end_ds").cast("long").alias("end_ds"))


def mask_runs(spark: SparkSession, d: str) -> DataFrame:
    return span_rows(b.waves(spark, d), iv.runs(ac.active(ac.frame_rms(F.col("wave"), HOP), threshold=0.5)))


def activity_spans(spark: SparkSession, d: str) -> DataFrame:
    return span_rows(b.waves(spark, d), ac.activity_spans(F.col("wave"), HOP, 1, F.lit(FRAMES), threshold=0.5, gap=3))


def fade(spark: SparkSession, d: str) -> DataFrame:
    return exploded(b.waves(spark, d), ac.faded(F.col("wave"), 8))


def clip_guard(spark: SparkSession, d: str) -> DataFrame:
    return exploded(b.waves(spark, d), ac.guarded(ac.gained(F.col("wave"), 12.0)))


def echo(spark: SparkSession, d: str) -> DataFrame:
    return exploded(b.waves(spark, d), ac.echoed(F.col("wave"), 5, -6.0))


def smoothing(spark: SparkSession, d: str) -> DataFrame:
    return exploded(b.waves(spark, d), ac.smoothed(F.col("wave")))


def stem_sum(spark: SparkSession, d: str) -> DataFrame:
    return exploded(b.waves(spark, d), ac.summed(F.array(F.col("wave"), ac.placed(F.col("wave"), 3, 64))))


QUERIES = {f.__name__: f for f in (frame_rms, activity_mask, mask_runs, activity_spans, fade, clip_guard, echo, smoothing, stem_sum)}

X = "x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
RMS = f"{X}, rms AS (SELECT vec_id, pos // 4 AS pos, sqrt(sum(v * v) / 4) AS v FROM x GROUP BY ALL)"
MASK = f"{RMS}, mask AS (SELECT vec_id, pos, v > 0.5::DOUBLE * max(v) OVER (PARTITION BY vec_id) AS \"on\" FROM rms)"
RUNS = f"{MASK}, g AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM mask WHERE \"on\"), runs AS (SELECT vec_id, min(pos) AS start_ds, max(pos) + 1 AS end_ds FROM g GROUP BY vec_id, g)"
SPANS = f"""{RUNS}, n AS (SELECT *, CASE WHEN start_ds - lag(end_ds) OVER (PARTITION BY vec_id ORDER BY start_ds) < 3 THEN 0 ELSE 1 END AS new FROM runs),
i AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY start_ds ROWS UNBOUNDED PRECEDING) AS i FROM n), spans AS (SELECT vec_id, min(start_ds) AS start_ds, max(end_ds) AS end_ds FROM i GROUP BY vec_id, i)"""
ORACLES = {
    "frame_rms": f"WITH {RMS} SELECT vec_id, pos, round(v, 6) AS v FROM rms",
    "activity_mask": f"WITH {MASK} SELECT * FROM mask",
    "mask_runs": f"WITH {RUNS} SELECT * FROM runs",
    "activity_spans": f"WITH {SPANS} SELECT * FROM spans",
    "fade": f"WITH {X} SELECT vec_id, pos, round(v * least(1.0::DOUBLE, pos / 8.0::DOUBLE, (63 - pos) / 8.0::DOUBLE), 6) AS v FROM x",
    "clip_guard": f"WITH {X}, g AS (SELECT vec_id, pos, v * pow(10.0::DOUBLE, 12.0::DOUBLE / 20) AS v FROM x), p AS (SELECT *, max(abs(v)) OVER (PARTITION BY vec_id) AS m FROM g) SELECT vec_id, pos, round(CASE WHEN m > 0.99::DOUBLE THEN v * 0.99::DOUBLE / m ELSE v END, 6) AS v FROM p",
    "echo": f"WITH {X} SELECT vec_id, pos, round(v + coalesce(lag(v, 5) OVER (PARTITION BY vec_id ORDER BY pos), 0) * pow(10.0::DOUBLE, -6.0::DOUBLE / 20), 6) AS v FROM x",
    "smoothing": f"WITH {X} SELECT vec_id, pos, round(sum(v) OVER (PARTITION BY vec_id ORDER BY pos ROWS 9 PRECEDING) / 10, 6) AS v FROM x",
    "stem_sum": f"WITH {X} SELECT vec_id, pos, round(v + coalesce(lag(v, 3) OVER (PARTITION BY vec_id ORDER BY pos), 0), 6) AS v FROM x",
}
