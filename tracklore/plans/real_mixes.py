"""Queries over real mixes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import realmix
from . import bindings as b
from . import sql

LOW, HIGH = 20.0, 60.0


def real_mix_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each clip's sources by kind; those of types that aren't heard are the whole clip."""
    refs = b.references(spark, d)
    heard = F.when(F.col("ord") % 4 != 1, F.col("spans"))
    rows = refs.select("sample_id", realmix.kind_of(F.col("type")).alias("kind"), heard.alias("spans")).groupBy("sample_id", "kind").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = realmix.spans_or_whole(F.col("spans"), F.lit(b.CLIP_DS))
    return rows.select("sample_id", "kind", F.inline(spans)).select("sample_id", "kind", *(F.col(c).cast("long").alias(c) for c in ("start_ds", "end_ds")))


def clips_with_speech(spark: SparkSession, d: str) -> DataFrame:
    clips = b.references(spark, d).groupBy("sample_id").agg(F.collect_list(F.struct(F.col("type").alias("kind"))).alias("sources"))
    return realmix.containing(clips, ("speech", "lys")).select("sample_id", F.size("sources").cast("long").alias("n_sources"))


def chosen_files(spark: SparkSession, d: str) -> DataFrame:
    """A supplier of its nation for each customer, nations above 20 counted as 3."""
    category = F.when(F.col("c_nationkey") > 20, F.lit(3)).otherwise(F.col("c_nationkey"))
    asked = b.table(spark, d, "customer").select("c_custkey", category.alias("category"))
    files = b.table(spark, d, "supplier").select(F.col("s_nationkey").alias("category"), F.col("s_name").alias("path"))
    return realmix.chosen_files(asked, files, "c_custkey", "category", "path", "files-1")


def prose_answers(spark: SparkSession, d: str) -> DataFrame:
    """The number in a JSON object amid prose, moved into its bounds."""
    said = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("Sure, here it is:\n"), "props", F.lit("\nas asked")))
    rows = b.table(spark, d, "events").select("event_id", realmix.json_in(said, "k double")["k"].alias("k"))
    return rows.select("event_id", realmix.bounded(F.col("k"), LOW, HIGH).alias("k"))


QUERIES = {f.__name__: f for f in (real_mix_spans, clips_with_speech, chosen_files, prose_answers)}

ORACLES = {
    "real_mix_spans": f"WITH {sql.REFS}, k AS (SELECT sample_id, CASE WHEN type IN ('music', 'speech') THEN type ELSE 'sfx' END AS kind, ord, start_ds, end_ds FROM refs), heard AS (SELECT sample_id, kind, start_ds, end_ds FROM k WHERE ord % 4 <> 1),{sql.islands('heard', 'sample_id, kind', 1)} "
    "SELECT sample_id, kind, start_ds, end_ds FROM merged_heard UNION ALL SELECT DISTINCT sample_id, kind, 0, 300 FROM k WHERE (sample_id, kind) NOT IN (SELECT (sample_id, kind) FROM heard)",
    "clips_with_speech": f"WITH {sql.REFS} SELECT sample_id, count(*) AS n_sources FROM refs GROUP BY sample_id HAVING bool_or(type IN ('speech', 'lys'))",
    "chosen_files": "WITH f AS (SELECT s_nationkey AS category, s_name AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1 AS n, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier), "
    "a AS (SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN 3 ELSE c_nationkey END AS category, CAST(('0x' || substr(md5('files-1:' || c_custkey), 1, 13)) AS BIGINT) AS u FROM customer) "
    "SELECT a.c_custkey, a.category, f.path FROM a LEFT JOIN f ON f.category = a.category AND f.n = a.u % f.total",
    "prose_answers": f"SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN greatest({LOW}::DOUBLE, least({HIGH}::DOUBLE, CAST(json_extract(props, '$.k') AS DOUBLE))) END AS k FROM events",
}
