"""Streams of ledgers: faulty lines are kept apart, and counts close their windows."""

import json

from pyspark.sql import functions as F

from tracklore.operators.ledger import VERSION
from tracklore.streaming import ingest


def test_faulty_lines_are_kept_apart(spark, tmp_path):
    good = {"schema_version": VERSION, "sample_id": "c1", "duration_sec": 3.0}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([json.dumps(good), "not json", "", json.dumps(good | {"sample_id": "c2", "schema_version": "0.0"}), "{}"]))
    for name, stream in (("ledgers", ingest.ledger_stream), ("faults", ingest.fault_stream)):
        query = ingest.write_batches(stream(spark, str(tmp_path / "in")), lambda df: df, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        query.awaitTermination(60)
    assert {x.sample_id for x in spark.read.parquet(str(tmp_path / "ledgers")).collect()} == {"c1", "c2"}
    faults = [(x.json, x.error) for x in spark.read.parquet(str(tmp_path / "faults")).collect()]
    assert sorted(e for _, e in faults) == ["no sample_id", "no sample_id", "other schema version"] and ("not json", "no sample_id") in faults


def test_counts_per_window(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "click", 1.0), ("2024-01-01 00:50:00", "click", 2.0), ("2024-01-01 01:10:00", "view", 5.0), ("2024-01-01 09:00:00", "view", 1.0)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    query = ingest.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(str(x.start)[11:16], x.event_type): (x.n, x.total) for x in spark.table("counts").collect()}
    assert got == {("00:00", "click"): (2, 3.0), ("01:00", "view"): (1, 5.0)}  # the last window is still open
