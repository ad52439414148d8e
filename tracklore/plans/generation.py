"""Queries over synthetic scenes, renders and codecs; checked by rows and by their tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import codecs, generate, match, recovery
from ..operators import dataset as ds
from ..operators import ledger as lg
from . import bindings as b
from . import captions, sql


def scene_ids(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("scene_id"))


def sample_scene(spark: SparkSession, d: str) -> DataFrame:
    ids = b.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("scene_id"))
    return generate.scenes(ids).select("scene_id", "template", F.inline("sources"))


def render_validate(spark: SparkSession, d: str) -> DataFrame:
    made = generate.scenes(scene_ids(spark, d))
    return generate.validated(made.join(generate.rendered(made), "scene_id"))


def mock_degrade(spark: SparkSession, d: str) -> DataFrame:
    refs = b.references(spark, d)
    matched = match.matches(match.candidates(refs, generate.degraded(refs)))
    return matched.groupBy("type").agg(F.count("*").alias("n_matched"), F.round(F.avg("tiou"), 6).alias("mean_tiou"))


def cut_captions(spark: SparkSession, d: str, *makes) -> DataFrame:
    """(sample_id, text, duration_sec): captions of one of the forms `makes`, one in five of them cut off."""
    clips = lg.nested(b.references(spark, d))
    u = lambda seed: ds.uniform(F.col("sample_id"), seed)
    caption = makes[0](F.col("events"))
    for k, make in enumerate(makes[1:], 1):
        caption = F.when(u("form-1") * len(makes) >= k, make(F.col("events"))).otherwise(caption)
    return clips.select("sample_id", caption.alias("text")).select("sample_id", F.when(u("cut-1") < 0.2, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"), F.lit(30.0).alias("duration_sec"))


def recover_captions(spark: SparkSession, d: str) -> DataFrame:
    """The tolerant reader over XML captions, some of them cut off."""
    return ds.parse_summary(recovery.recovered(cut_captions(spark, d, tx.xml_caption)))


def parse_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Captions of time tokens and of XML, some of them cut off, read in the form that fits."""
    return recovery.cascade(cut_captions(spark, d, tx.atomic_caption, tx.xml_caption)).select("sample_id", "form", "ok", "events_recovered", "events_rejected", "error")


def recover_faulty(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of fault at its place: no time, no text, no body, an odd confidence, an end after the clip; each fourth clip is a strict document."""
    refs = b.references(spark, d)
    e = F.element_at("spans", 1)
    time = F.concat(F.lit(' t="'), tx.short_number(e["start_ds"]), F.lit("-"), tx.short_number(F.when(F.col("ord") % 17 == 5, F.lit(310)).otherwise(e["end_ds"])), F.lit('"'))
    attributes = F.concat(F.when(F.col("ord") % 5 == 1, F.lit("")).otherwise(time), F.when(F.col("ord") % 13 == 4, F.lit(' confidence="high"')).otherwise(F.lit(' confidence="0.5"')))
    body = F.when(F.col("ord") % 7 == 2, F.lit(" ")).otherwise(F.col("text"))
    element = F.when(F.col("ord") % 11 == 3, F.concat(F.lit("<"), "type", time, F.lit("/>"))).otherwise(F.concat(F.lit("<"), "type", attributes, F.lit(">"), body, F.lit("</"), "type", F.lit(">")))
    faulty = refs.select("sample_id", F.struct("ord", element.alias("x")).alias("x")).groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda v: v["x"]), "\n").alias("faulty"), F.count("*").alias("n"))
    events = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(F.format_string("E%03d", i).alias("id"), F.lit("sfx").alias("type"), F.array(F.struct(F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"))).alias("spans"), F.lit("a bang").alias("text"), F.lit(0.5).alias("confidence")))
    whole = F.to_json(F.struct(F.lit(lg.VERSION).alias("schema_version"), "sample_id", F.lit(30.0).alias("duration_sec"), F.lit(0.1).alias("time_resolution_sec"), F.array().cast("array<string>").alias("tracks"), events.alias("events")))
    text = F.when(F.col("n") % 4 == 0, codecs.to_xml(whole)).otherwise(F.col("faulty"))
    read = recovery.recovered(faulty.select("sample_id", text.alias("text"), F.lit(30.0).alias("duration_sec")))
    return read.select("sample_id", "strict_format_success", "events_recovered", "events_rejected", F.size("warnings").cast("long").alias("n_warnings"), "error")


QUERIES = {f.__name__: f for f in (recover_faulty, sample_scene, render_validate, mock_degrade, recover_captions, parse_cascade)}

U = "CAST(('0x' || substr(md5('{0}:' || {1}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
CUT = f"""WITH {sql.REFS}, a AS (SELECT sample_id, string_agg({captions.ONE}, '' ORDER BY start_ds, {captions.RANK}, event_id) AS atomic, string_agg({captions.XML}, chr(10) ORDER BY start_ds, {captions.RANK}, event_id) AS xml FROM refs GROUP BY ALL),
h AS (SELECT *, {U.format('form-1', 'sample_id')} AS u, {U.format('cut-1', 'sample_id')} AS c FROM a)"""
XML_EVENTS = "len(regexp_extract_all(t, '" + "|".join(f"<{k} [^<>]*>[^<]+</{k}>" for k in tx.TYPES) + "'))"
ATOMIC_EVENTS = "len(regexp_extract_all(t, '<[a-z]+><[|]t_[0-9]{3}[|]>[^<]*<[|]t_[0-9]{3}[|]></[a-z]+>'))"
ORACLES: dict[str, str] = {
    "recover_captions": f"{CUT}, t AS (SELECT CASE WHEN c < 0.2 THEN substr(xml, 1, 40) ELSE xml END AS t FROM h) SELECT count(*) AS n_samples, 0::BIGINT AS n_ok, 0.0::DOUBLE AS strict_format_success_rate, round(sum({XML_EVENTS}) / CAST(count(*) AS DOUBLE), 3) AS mean_events_recovered, 0::BIGINT AS total_events_rejected FROM t",
    "parse_cascade": f"{CUT}, t AS (SELECT sample_id, CASE WHEN c < 0.2 THEN substr(x, 1, 40) ELSE x END AS t FROM (SELECT *, CASE WHEN u * 2 >= 1 THEN xml ELSE atomic END AS x FROM h)), "
    f"n AS (SELECT sample_id, {ATOMIC_EVENTS} AS a, {XML_EVENTS} AS x FROM t) SELECT sample_id, CASE WHEN a > 0 THEN 'atomic' ELSE 'tolerant' END AS form, a > 0 AS ok, CASE WHEN a > 0 THEN a ELSE x END AS events_recovered, 0::BIGINT AS events_rejected, NULL::VARCHAR AS error FROM n",
    "recover_faulty": f"""WITH {sql.REFS}, e AS (SELECT sample_id, ord % 11 = 3 AS closed, ord % 5 = 1 AS untimed, ord % 7 = 2 AS silent, ord % 13 = 4 AS unsure, ord % 17 = 5 AS late FROM refs),
k AS (SELECT *, NOT closed AND NOT untimed AND NOT silent AS kept FROM e),
c AS (SELECT sample_id, count(*) AS n, count(*) FILTER (kept) AS r, count(*) FILTER (kept AND unsure) AS u, bool_or(kept AND late) AS late FROM k GROUP BY ALL)
SELECT sample_id, n % 4 = 0 AS strict_format_success, CASE WHEN n % 4 = 0 THEN n ELSE r END AS events_recovered, CASE WHEN n % 4 = 0 THEN 0 ELSE n - r END AS events_rejected, CASE WHEN n % 4 = 0 THEN 0 ELSE 1 + u END AS n_warnings,
CASE WHEN n % 4 <> 0 AND late THEN 'an event ends after the clip' END AS error FROM c""",
}
