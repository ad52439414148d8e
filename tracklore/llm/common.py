"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir`` or one that the caller has set;
    without either this is an error on a cluster, where a machine's own folder would be
    wrong, and a temporary folder on one machine (a local master).
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", "") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files and broadcasts of what nothing refers to any more."""
    df.sparkSession.sparkContext._jvm.System.gc()


def sized(df: DataFrame, most: int) -> DataFrame:
    """A staged `df`, to be broadcast in joins if it has at most `most` rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def given_back() -> None:
    """At the end of a task: memory that Arrow holds for reuse goes back to the machine, as an idle worker would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()


def raw_text(column: str = "text"):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def per_row(df: DataFrame, make: Callable[[], Callable[[bytes], tuple]], keys: list[str], text: str, schema: str) -> DataFrame:
    """Runs a per-text function over Arrow batches.

    `make` is called once a task and returns the function; its result fills the columns
    after `keys` in `schema`; `AT_ONCE` rows are held at a time. Only `keys` and `text` are read, so extra columns of any
    name do no harm.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, max(1, whole.num_rows), AT_ONCE)):
            made = [each(x) for x in batch.column(n).to_pylist()]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in fields[n:]]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(c, f.type) for c, f in zip(columns, fields[n:], strict=True)], names=[f.name for f in fields])
        given_back()

    picked = df.select(*(F.col(k) for k in keys), raw_text(text).alias("raw__"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    return picked.mapInArrow(run, schema)
