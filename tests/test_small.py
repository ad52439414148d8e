"""Small functions that no query runs, against worked cases."""

import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from tracklore.functions import intervals as iv
from tracklore.functions import text as tx
from tracklore.operators import activity, codecs, dataset, validate
from tracklore.sources import ledgers


def test_windows_repeats_and_coarser_masks(spark):
    r = random.Random(1)
    wave = [r.uniform(-1, 1) for _ in range(23)]
    mask = [r.random() < 0.3 for _ in range(17)]
    row = spark.createDataFrame([(wave, mask)], "w array<double>, m array<boolean>").select(
        activity.windowed_rms(F.col("w"), 4, 7).alias("rms"), activity.repeated(F.col("w"), 3, 2).alias("again"), *(activity.coarser(F.col("m"), k).alias(f"m{k}") for k in (1, 3, 5))
    ).first()
    parts = [wave[max(0, i * 4 - 3) : i * 4 + 4] for i in range(6)]
    assert [round(x, 9) for x in row.rms] == [round(math.sqrt(sum(v * v for v in p) / len(p)), 9) for p in parts]
    assert row.again == (wave + [0.0, 0.0]) * 2 + wave
    for k in (1, 3, 5):
        assert row[f"m{k}"] == [any(mask[i : i + k]) for i in range(0, len(mask), k)]


def test_unknown_fields_by_level(spark):
    rows = [("c1", json.dumps({"sample_id": "c1", "odd": 1, "conditions": {"codec": "x", "wind": 3}})), ("c2", json.dumps({"sample_id": "c2"}))]
    found = validate.unknown_fields(spark.createDataFrame(rows, "sample_id string, json string"), {"$": ["sample_id", "conditions"], "$.conditions": ["codec"]})
    assert sorted((x.sample_id, x.owner_id) for x in found.collect()) == [("c1", "odd"), ("c1", "wind")]


def test_manifests_of_the_flat_layout(spark):
    schema = "scene_id string, duration double, audio_path string, ledger struct<sample_id:string>, sources array<struct<type:string,role:string,onset:double,gain_db:double,caption:string>>"
    mix = spark.createDataFrame([("s1", 9.0, "a.wav", ("s1",), [("speech", "fg", 0.5, -3.0, "hi"), ("sfx", "bg", 0.0, 0.0, "bang")])], schema)
    row = ledgers.converted_manifest(mix).first()
    assert (row.scene.scene_id, row.scene.template, row.mixture_path, row.target_ledger.sample_id) == ("s1", "real_mix", "a.wav", "s1")
    assert [(s.source_id, s.kind, s.path, s.text) for s in row.scene.sources] == [("S0", "speech", "real:fg", "hi"), ("S1", "sfx", "real:bg", "bang")]


def test_texts_of_events_for_reviews(spark):
    events = [("sfx", [(5, 12), (30, 41)], "x" * 40), ("music", [(0, 100)], "tune")]
    df = spark.createDataFrame([(events,)], f"e array<struct<type:string,spans:{iv.SPANS},text:string>>")
    assert df.select(tx.review_text(F.col("e")).alias("t")).first().t == f"sfx [0.5-4.1] {'x' * 30} | music [0.0-10.0] tune"


def test_hashes_and_samples(spark):
    df = spark.createDataFrame([(i, f"k{i}") for i in range(200)], "i int, k string")
    row = df.where("i = 7").select(dataset.seed_of(F.col("k")).alias("s"), dataset.short_sha256(F.col("k")).alias("h")).first()
    digest = hashlib.sha256(b"k7").hexdigest()
    assert (row.s, row.h) == (int(digest[:8], 16), digest[:16])
    some = [x.i for x in dataset.sample_rows(df, "k", 9, "a").collect()]
    assert len(set(some)) == 9 and some == [x.i for x in dataset.sample_rows(df.repartition(5), "k", 9, "a").collect()]
    assert some != [x.i for x in dataset.sample_rows(df, "k", 9, "b").collect()]


def test_uncertain_times_and_typed_attributes_go_there_and_back():
    spans = [{"start_sec": 1.0, "end_sec": 2.5, "start_uncertainty_sec": 0.1, "end_uncertainty_sec": None}, {"start_sec": 3.0, "end_sec": 4.0, "start_uncertainty_sec": None, "end_uncertainty_sec": None}]
    written = codecs.times(spans)
    assert written == {"t": "1-2.5,3-4", "tu": "0.1|;|"} and codecs.read_times(written) == spans
    assert codecs.times([]) == {} and codecs.times([{"start_sec": 0.0, "end_sec": 0.1}]) == {"t": "0-0.1"}
    event = {"id": "E001", "type": "sfx", "spans": [{"start_sec": 1.0, "end_sec": 2.0}], "text": "bang", "confidence": 0.5, "attributes": {"loud": True, "level": 0.25, "name": "a b"}}
    ledger = {"schema_version": codecs.VERSION, "sample_id": "c", "duration_sec": 5.0, "time_resolution_sec": 0.1, "tracks": [], "events": [event]}
    assert codecs.read_xml(codecs.write_xml(ledger))["events"][0]["attributes"] == event["attributes"]
