"""Ledgers, captions and waveforms derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv

CLIP_DS = 300
TYPE_OF = {"click": "sfx", "view": "music", "purchase": "speech", "signup": "lys", "error": "sfx"}
TRACK_OF = {"speech": "T1", "lys": "T2", "music": "T3", "sfx": "T4"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column, values: dict[str, str]):
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[column]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a clip is a user's day, its 24 hours mapped to 30 seconds."""
    e = table(spark, sf_dir, "events")
    start = F.expr("cast((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) div 288 as int)")
    rows = e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("sample_id"), "event_id", mapped(F.col("event_type"), TYPE_OF).alias("type"),
        F.col("event_type").alias("text"), start.alias("start_ds"), (1 + F.round(F.col("value") * 100).cast("long") % 50).alias("len"),
    )
    return rows.withColumn("end_ds", F.least(F.lit(CLIP_DS), F.col("start_ds") + F.col("len")).cast("int")).drop("len")


def flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "sample_id", F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"), F.col("event_id").cast("long").alias("ord"), "type", mapped(F.col("type"), TRACK_OF).alias("track_id"),
        "text", F.lit(0.9).alias("confidence"), F.array(iv.span(F.col("start_ds"), F.col("end_ds"))).alias("spans"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(base(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with omissions, shifted starts, wrong types and additions, all by the event id."""
    b = base(spark, sf_dir)
    start = F.greatest(F.lit(0), F.col("start_ds") + (F.col("event_id") % 7) - 3).cast("int")
    kept = b.where("event_id % 10 <> 3").select("sample_id", "event_id", F.when(F.col("event_id") % 11 == 5, "sfx").otherwise(F.col("type")).alias("type"), "text", start.alias("start_ds"), F.greatest(start + 1, F.col("end_ds")).alias("end_ds"))
    at = ((F.col("start_ds") + 100) % 290).cast("int")
    more = b.where("event_id % 13 = 0").select("sample_id", (F.col("event_id") + 1_000_000_000).alias("event_id"), "type", "text", at.alias("start_ds"), (at + 10).alias("end_ds"))
    return flat(kept.unionByName(more))


def clips(events: DataFrame) -> DataFrame:
    return events.select("sample_id").distinct().withColumn("duration_ds", F.lit(CLIP_DS))


def track_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("sample_id").agg(F.countDistinct("track_id").alias("n_tracks"))


def conditions(events: DataFrame) -> DataFrame:
    """Per clip conditions that follow from its id's length and its events."""
    n = F.count("*")
    return events.groupBy("sample_id").agg(
        F.when(n % 5 == 0, None).otherwise((n % 4) * 0.25 + 0.2).alias("t60_sec"), ((n % 6) * 0.1).alias("overlap_ratio"), (10.0 + (n % 5) * 4.0).alias("duration"),
        F.countDistinct("track_id").alias("source_count"), F.min("type").alias("template"), F.when(n % 3 == 0, (n % 2) * 40).alias("echo"),
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waveforms of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("wave"))
