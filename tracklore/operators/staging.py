"""Cutting the lineage of loops, and dealing rows to tasks of bounded size."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame

TASK_ROWS = 1 << 18


def kept(df: DataFrame) -> DataFrame:
    """`df` written to the folder of ``spark.checkpoint.dir`` and read back; a cluster has to name the folder, a local master gets a temporary one.

    A checkpoint would hand on what the optimizer knows of its rows, and in a loop the
    conditions that it infers multiply with each turn, until planning takes minutes. Files
    hand on nothing but their size. Like checkpoints they stay until the folder is cleaned.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not (folder := spark.conf.get("spark.checkpoint.dir", "")) and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/kept-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """`df` dealt by its keys to tasks of some `TASK_ROWS` rows, so that a task's memory doesn't grow with the table.

    `rows` is the number of rows to deal; by default `df` is counted. Equal keys stay together.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
