"""Stem ledgers, reviews, scenes and reports on small cases."""

import json

from pyspark.sql import functions as F

from tracklore.functions import intervals as iv
from tracklore.operators import dataset, stems
from tracklore.sources import ledgers


def test_stems_give_events_of_their_activity(spark):
    loud, soft = [0.0] * 4 + [1.0] * 4 + [0.0] * 20 + [1.0] * 4, [0.001] * 32
    rows = [("c", 0, "vocals", loud, "x" * 200), ("c", 1, "drums", soft, None), ("c", 2, "other", loud, ""), ("c", 3, "kazoo", loud, None), ("d", 0, "drums", None, None)]
    many = [v for _ in range(5) for v in [1.0] * 4 + [0.0] * 16]
    df = spark.createDataFrame([*rows, ("e", 0, "drums", many, None)], "sample_id string, pos int, stem string, wave array<double>, caption string")
    got = stems.stem_events(df, 4, 25).collect()
    seen = {(x.sample_id, x.event_id): (x.type, x.text, [tuple(s) for s in x.spans]) for x in got}
    assert seen["c", "E001"] == ("lys", "x" * 80, [(1, 2)]) and seen["c", "E002"][2] == [(7, 8)]
    assert seen["c", "E003"] == ("music", "stem other", [(1, 2)]) and seen["c", "E005"][:2] == ("sfx", "stem kazoo")
    assert sum(x.sample_id == "e" for x in got) == 3 and not any(x.sample_id == "d" for x in got)


def test_oracle_times_and_clamps(spark):
    events = spark.createDataFrame([("c", "E2", "lys", [(5, 9)]), ("c", "E1", "lys", [(5, 8)]), ("c", "E3", "lys", [(1, 2)])], f"sample_id string, event_id string, type string, spans {iv.SPANS}")
    src = spark.createDataFrame([("c", 0, "vocal", 40, 50, "words", None), ("c", 1, "music", 40, 50, None, None), ("c", 2, "odd", 10, 50, "t", "heard")], "sample_id string, pos int, kind string, onset_ds int, duration_ds int, text string, caption string")
    got = {x.event_id: (x.type, x.text, [tuple(s) for s in x.spans]) for x in stems.oracle_events(src, events).collect()}
    assert got == {"E001": ("lys", "words", [(1, 2)]), "E002": ("music", "an event", [(40, 50)]), "E003": ("sfx", "heard", [(10, 30)])}
    spans = spark.createDataFrame([([(-5, 3), (48, 70), (60, 70), (7, 7)],)], f"s {iv.SPANS}")
    assert [tuple(x) for x in spans.select(stems.clamped(F.col("s"), F.lit(50)).alias("c")).first().c] == [(0, 3), (48, 50), (49, 50), (7, 8)]


def test_reviews_of_clips_without_events(spark):
    kinds = f"sample_id string, event_id string, type string, text string, spans {iv.SPANS}"
    refs = spark.createDataFrame([("a", "E1", "sfx", "bang", [(5, 9)]), ("b", "E1", "sfx", "bang", [(5, 9)])], kinds)
    hyps = spark.createDataFrame([("a", "E1", "sfx", "pop", [(5, 8)]), ("a", "E2", "music", "pop", [(0, 12)])], kinds)
    got = {x.sample_id: x for x in stems.review_rows(spark.createDataFrame([("a",), ("b",), ("z",)], "sample_id string"), refs, hyps).collect()}
    assert got["a"].match == "halluc" and got["a"].pred_events == "music [0.0-1.2] pop | sfx [0.5-0.8] pop" and got["a"].errors == "correct=1 halluc=1 omit=0"
    assert got["b"].match == "omit" and got["b"].pred_events == "(parse failed)" and got["z"].match == "correct"


def test_scenes_go_there_and_back(spark):
    source = {"source_id": "S1", "kind": "sfx", "path": "a.wav", "onset": 0.5, "gain_db": -3.0, "text": "bang"}
    scenes = [{"scene_id": "s1", "seed": 7, "duration": 10.0, "template": "day", "sources": [source, source | {"repeat": 3, "is_foreground": False}], "conditions": {"t60_sec": 0.4}}, {"scene_id": "s2", "seed": 1, "duration": 5.0, "template": "x", "sources": [], "sample_rate": 16000}]
    df = spark.createDataFrame([(json.dumps(s),) for s in scenes] + [("no scene",), (None,)], "j string").withColumn("scene", ledgers.read_scene(F.col("j")))
    back = df.withColumn("back", ledgers.read_scene(ledgers.scene_json(F.col("scene")))).collect()
    assert all(x.scene == x.back for x in back) and [x.scene is None for x in back] == [False, False, True, True]
    one = back[0].scene
    assert (one.sources[0].repeat, one.sources[1].repeat, one.sources[0].is_foreground, one.sample_rate, one.supervision.style, one.conditions.t60_sec) == (1, 3, True, 24_000, "brief", 0.4)


def test_inference_report_has_rows(spark, tmp_path):
    reports = spark.createDataFrame([("b", True, True, 2, 0, ["w"] * 9, "r" * 900), ("a", False, False, 0, 3, None, None)], "sample_id string, ok boolean, strict_format_success boolean, events_recovered int, events_rejected int, warnings array<string>, raw_text string")
    ledgers.write_inference_report(reports, str(tmp_path / "r"), "mock")
    report = json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("part-*")))
    assert (report["backend"], report["n_samples"], report["n_ok"], report["total_events_rejected"]) == ("mock", 2, 1, 3)
    assert [(x["sample_id"], len(x["warnings"]), x["raw_text"]) for x in report["samples"]] == [("a", 0, None), ("b", 5, "r" * 500)]


def test_texts_that_share_five_words(spark):
    left = spark.createDataFrame([(1, "x A b  c d e y"), (2, "a b c d"), (3, None), (4, "a b c d e a b c d e")], "l int, text string")
    right = spark.createDataFrame([(7, "a b c d E"), (8, "a b c d"), (9, "b c d e y z")], "r int, text string")
    assert {tuple(x) for x in dataset.sharing_pairs(left, right, "l", "r").collect()} == {(1, 7), (1, 9), (4, 7)}
