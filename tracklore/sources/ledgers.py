"""Reading and writing ledgers, manifests, reports, transcripts and sound files."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dataset
from ..operators.ledger import LEDGER_JSON, VERSION


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(json, place) of the lines of JSONL files that aren't blank; places sort in file order."""
    rows = spark.read.text(path).select(F.col("value").alias("json"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("place"))
    return rows.where(F.trim("json") != "")


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """One row per clip with the ledger's fields; of several with one id the last counts.

    A manifest row stands for its `target_ledger`. `error` says why a line isn't a ledger;
    such lines keep their row, with null fields.
    """
    rows = json_lines(spark, path)
    bare = F.get_json_object("json", "$.schema_version").isNotNull()
    text = F.when(bare, F.col("json")).otherwise(F.coalesce(F.get_json_object("json", "$.target_ledger"), F.get_json_object("json", "$.ledger"), F.col("json")))
    parsed = rows.select("place", F.from_json(text, LEDGER_JSON).alias("l")).select("place", "l.*")
    wrong = F.when(F.col("sample_id").isNull(), "no sample_id").when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "other schema version")
    key = F.coalesce("sample_id", F.col("place").cast("string"))
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("place").desc()))
    none = lambda c: F.coalesce(c, F.array().cast(parsed.schema[c].dataType))
    return parsed.withColumn("error", wrong).withColumn("latest_", latest).where("latest_ = 1").drop("latest_", "place").withColumns({"tracks": none("tracks"), "events": none("events")})


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Manifest rows; give the schema in production, it is inferred otherwise."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSONL, null fields included, text as it is."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The per-clip rows of a metrics report, a JSON document with an array `samples`."""
    return spark.read.json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")


def write_report(summary: DataFrame, rows: DataFrame, path: str, name: str = "samples") -> None:
    """A report as one JSON document: the fields of the one row `summary` and the array `name` of all `rows`.

    A document is one value, so this is for reports that a reader opens whole; of a large
    corpus write the rows with `write_json_lines` instead.
    """
    order = rows.columns[0]
    samples = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias(name))
    summary.crossJoin(samples).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report_rows(reports: DataFrame) -> DataFrame:
    """The rows of an inference report: what was read of each raw text, with five warnings and 500 characters of it at most.

    `reports` has sample_id, ok, strict_format_success, events_recovered, events_rejected,
    warnings and raw_text, which may be null.
    """
    kept = ("sample_id", "ok", "strict_format_success", "events_recovered", "events_rejected")
    return reports.select(*kept, F.slice(F.coalesce("warnings", F.array().cast("array<string>")), 1, 5).alias("warnings"), F.substring("raw_text", 1, 500).alias("raw_text"))


def write_inference_report(reports: DataFrame, path: str, backend: str) -> None:
    """The summary of parsed outputs and their rows as one JSON document, as `write_report` does."""
    summary = dataset.parse_summary(reports).select(F.lit(backend).alias("backend"), "*")
    write_report(summary, report_rows(reports), path)


#: A scene as manifests hold it, and what a scene has that leaves a field out.
SOURCE = "source_id string, kind string, path string, onset double, gain_db double, text string, identity string, repeat int, repeat_gap_s double, rir_id string, t60_sec double, is_foreground boolean"
SCENE = (
    f"scene_id string, seed bigint, duration double, template string, sources array<struct<{SOURCE.replace(' ', ':').replace(',:', ',')}>>, "
    "conditions struct<noise_snr_db:double,echo_delay_ms:double,echo_atten_db:double,t60_sec:double,codec:string,overlap_ratio:double>, "
    "supervision struct<style:string,activity_threshold:double,merge_threshold_s:double,resolution_s:double>, sample_rate int"
)
SOURCE_DEFAULTS = {"repeat": 1, "repeat_gap_s": 0.0, "is_foreground": True}
SUPERVISION_DEFAULTS = {"style": "brief", "activity_threshold": 0.05, "merge_threshold_s": 0.25, "resolution_s": 0.1}


def read_scene(text: Column) -> Column:
    """A scene's JSON as a struct with every field, those left out with their defaults; null where it isn't one."""
    s = F.from_json(text, SCENE)
    fields = lambda ddl: [x.split()[0] for x in ddl.split(", ")]
    or_else = lambda value, defaults, c: F.coalesce(value[c], F.lit(defaults[c])) if c in defaults else value[c]
    sources = F.transform(s["sources"], lambda x: F.struct(*(or_else(x, SOURCE_DEFAULTS, c).alias(c) for c in fields(SOURCE))))
    conditions = F.struct(*(s["conditions"][c].alias(c) for c in ("noise_snr_db", "echo_delay_ms", "echo_atten_db", "t60_sec", "codec", "overlap_ratio")))
    supervision = F.struct(*(F.coalesce(s["supervision"][c], F.lit(v)).alias(c) for c, v in SUPERVISION_DEFAULTS.items()))
    whole = F.struct(*(s[c].alias(c) for c in ("scene_id", "seed", "duration", "template")), sources.alias("sources"), conditions.alias("conditions"), supervision.alias("supervision"), F.coalesce(s["sample_rate"], F.lit(24_000)).alias("sample_rate"))
    return F.when(s["scene_id"].isNotNull(), whole)


def scene_json(scene: Column) -> Column:
    """The JSON of a scene, null fields included; `read_scene` gives the scene back."""
    return F.to_json(scene, {"ignoreNullFields": "false"})


def write_strata(strata: DataFrame, path: str) -> None:
    """Strata (axis, bucket, ..) as one JSON document: axis, then bucket, then measures; a few rows per axis."""
    measures = [c for c in strata.columns if c not in ("axis", "bucket")]
    by_axis = strata.groupBy("axis").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", F.struct(*measures).alias("m"))))).alias("buckets"))
    whole = by_axis.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", F.to_json("buckets").alias("b"))))).alias("all_"))
    parts = F.transform(F.map_entries("all_"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    whole.select(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_strata(spark: SparkSession, path: str, measures: str) -> DataFrame:
    """(axis, bucket, ..) of the document that `write_strata` makes; `measures` is a DDL of the measures' fields."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,map<string,struct<{measures}>>>")).alias("axis", "buckets"))
    return rows.select("axis", F.explode("buckets").alias("bucket", "m")).select("axis", "bucket", "m.*")


def listen_list(manifest: DataFrame) -> DataFrame:
    """(scene_id, template, mixture_path, duration, n_events, first_event_text) to check clips by ear."""
    events = F.col("target_ledger.events")
    return manifest.select(F.col("scene.scene_id").alias("scene_id"), F.col("scene.template").alias("template"), "mixture_path", F.col("scene.duration").alias("duration"), F.greatest(F.size(events), F.lit(0)).alias("n_events"), F.coalesce(F.try_element_at(events, F.lit(1))["text"], F.lit("")).alias("first_event_text"))


def conditions_of(manifest: DataFrame) -> DataFrame:
    """Per clip the axes of the strata from `manifest(scene, target_ledger)`; the last row of a clip counts.

    What the scene leaves out of t60_sec, overlap_ratio, snr_db and echo comes from the
    ledger's conditions, if the manifest has any. n_events counts the events that the scene
    itself lists; null, if it lists none.
    """
    has = lambda path, df=manifest: _field(df.schema, path)
    scene = lambda c: F.col(f"scene.conditions.{c}") if has(f"scene.conditions.{c}") else F.lit(None)
    target = lambda c: F.col(f"target_ledger.conditions.{c}") if has(f"target_ledger.conditions.{c}") else F.lit(None)
    top = lambda c: F.col(f"scene.{c}") if has(f"scene.{c}") else F.lit(None)
    echo = F.coalesce(scene("echo_delay_ms").cast("string"), scene("echo").cast("string"), target("echo").cast("string"))
    n_events = F.when(top("events").isNotNull(), F.size(top("events"))) if has("scene.events") else F.lit(None).cast("int")
    rows = manifest.select(
        F.col("scene.scene_id").alias("sample_id"), F.coalesce(scene("t60_sec"), target("t60_sec")).cast("double").alias("t60_sec"), F.coalesce(scene("overlap_ratio"), target("overlap_ratio")).cast("double").alias("overlap_ratio"),
        top("duration").cast("double").alias("duration"), F.greatest(F.size(top("sources")), F.lit(0)).alias("source_count") if has("scene.sources") else F.lit(0).alias("source_count"), top("template").cast("string").alias("template"), echo.alias("echo"),
        F.coalesce(scene("noise_snr_db"), scene("snr_db"), target("snr_db")).cast("double").alias("snr_db"), scene("codec").cast("string").alias("codec"), n_events.alias("n_events"), F.monotonically_increasing_id().alias("place_"),
    )
    fields = [c for c in rows.columns if c not in ("sample_id", "place_")]
    return rows.groupBy("sample_id").agg(F.max_by(F.struct(*fields), "place_").alias("x")).select("sample_id", "x.*")


def _field(schema: StructType, path: str) -> bool:
    """Whether a schema has a nested field."""
    for name in path.split("."):
        if not isinstance(schema, StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
    return True


def converted_manifest(mix: DataFrame) -> DataFrame:
    """Rows of the flat layout (scene_id, audio_path, duration, ledger, sources) in the nested one."""
    sources = F.transform("sources", lambda s, i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("source_id"), s["type"].alias("kind"), F.concat(F.lit("real:"), s["role"]).alias("path"), s["onset"].alias("onset"), s["gain_db"].alias("gain_db"), s["caption"].alias("text")))
    scene = F.struct("scene_id", "duration", F.lit("real_mix").alias("template"), sources.alias("sources"))
    return mix.select(scene.alias("scene"), F.col("audio_path").alias("mixture_path"), F.col("ledger").alias("target_ledger"))


def unpivoted_sources(wide: DataFrame, n: int, fields: list[str]) -> DataFrame:
    """One row per source of a sheet with columns source_{k}_{field}; empty ones are left out."""
    one = lambda k: F.struct(F.lit(k).alias("source"), *(F.col(f"source_{k}_{f}").cast("string").alias(f) for f in fields))
    rows = wide.select("clip_id", F.explode(F.array(*(one(k) for k in range(1, n + 1)))).alias("s")).select("clip_id", "s.*")
    return rows.where(F.coalesce(*fields).isNotNull())


def write_review_csv(df: DataFrame, path: str) -> None:
    """A CSV with header and byte-order mark, for spreadsheets; one file per partition."""
    marked = df.columns[0]
    df.withColumnRenamed(marked, "﻿" + marked).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(utterance_id, text) of lines `id text`."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("utterance_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def with_transcripts(files: DataFrame, transcripts: DataFrame) -> DataFrame:
    """`files(utterance_id)` with their text, '' where there is none."""
    return files.join(transcripts, "utterance_id", "left").na.fill("", ["text"])


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of texts."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")))


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def decoded_wav(content: bytes, rate: int) -> np.ndarray:
    """Mono samples of a PCM WAV file at `rate`, resampled linearly."""
    with wave.open(io.BytesIO(content)) as w:
        kind = {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
        x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float64).reshape(-1, w.getnchannels()).mean(axis=1)
        x = (x - 128) / 128 if kind is np.uint8 else x / np.iinfo(kind).max
        n = round(len(x) * rate / w.getframerate())
        return x if w.getframerate() == rate or not n else np.interp(np.arange(n) * w.getframerate() / rate, np.arange(len(x)), x)


def read_audio(spark: SparkSession, path: str, rate: int) -> DataFrame:
    """(path, wave, error) of WAV files; a file that can't be read has an error and no waveform."""

    @F.pandas_udf("wave array<double>, error string")
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((decoded_wav(c, rate), None))
            except (wave.Error, EOFError, KeyError, ValueError) as fault:
                rows.append((None, str(fault)))
        return pd.DataFrame(rows, columns=["wave", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", decode("content").alias("d")).select("path", "d.*")


def encoded_wav(samples: Column, rate: int) -> Column:
    """A 16-bit mono WAV file, as bytes, of an array of samples from -1 to 1."""

    @F.pandas_udf("binary")
    def encode(column: pd.Series) -> pd.Series:
        def one(x) -> bytes:
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setparams((1, 2, rate, 0, "NONE", ""))
                w.writeframes((np.clip(np.asarray(x, np.float64), -1, 1) * 32767).round().astype("<i2").tobytes())
            return out.getvalue()

        return column.map(one)

    return encode(samples)
