"""Ledgers as a stream: the batch operators on files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import LEDGER_JSON, VERSION


def line_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The lines of JSONL files that appear in a folder: json, its ledger l, and `error` where it isn't one; blank lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).where(F.trim("value") != "")
    read = lines.select(F.col("value").alias("json"), F.from_json("value", LEDGER_JSON).alias("l"))
    wrong = F.when(F.col("l.sample_id").isNull(), "no sample_id").when(~F.col("l.schema_version").eqNullSafe(F.lit(VERSION)), "other schema version")
    return read.withColumn("error", wrong)


def ledger_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The ledgers of those lines; what isn't a ledger is in `fault_stream`."""
    return line_stream(spark, path, files_per_batch).where("l.sample_id is not null").select("l.*")


def fault_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(json, error) of the lines that aren't ledgers, or of another version, to be written beside the ledgers."""
    return line_stream(spark, path, files_per_batch).where("error is not null").select("json", "error")


def write_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch operator to each micro-batch and writes it under its number.

    A batch that is run again after a failure replaces its own output, so each is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per time window and type of a stream `events(ts, event_type, value)`, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
