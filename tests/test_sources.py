"""Reading and writing: ledgers, manifests, reports, sheets, transcripts, sound files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracklore.operators import ledger as lg
from tracklore.sources import ledgers as src


def ledger(ident, n=1, **more):
    events = [{"id": f"E{k:03d}", "type": "sfx", "track_id": "T1", "spans": [{"start_sec": k, "end_sec": k + 0.56}], "text": f"t{k}", "confidence": 0.5, "attributes": {"x": 1}} for k in range(n)]
    return {"schema_version": lg.VERSION, "sample_id": ident, "duration_sec": 10.0, "time_resolution_sec": 0.1, "tracks": [{"id": "T1", "kind": "sfx", "spans": [], "confidence": 1.0}], "events": events} | more


def test_ledgers_from_lines(spark, tmp_path):
    lines = [json.dumps(ledger("a")), "", json.dumps({"scene": {"scene_id": "b"}, "target_ledger": ledger("b", 2)}), "{broken", json.dumps(ledger("a", 3)), json.dumps(ledger("c", schema_version="0.1.0"))]
    (tmp_path / "l.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = {r.sample_id: r for r in src.read_ledgers(spark, str(tmp_path / "l.jsonl")).collect()}
    assert {k: (len(r.events), r.error) for k, r in got.items()} == {"a": (3, None), "b": (2, None), None: (0, "no sample_id"), "c": (1, "other schema version")}
    flat = lg.events_of(src.read_ledgers(spark, str(tmp_path / "l.jsonl")).where("sample_id = 'a'")).orderBy("ord").collect()
    assert [(r.event_id, r.spans[0].start_ds, r.spans[0].end_ds) for r in flat] == [("E000", 0, 6), ("E001", 10, 16), ("E002", 20, 26)]
    tracks = lg.tracks_of(src.read_ledgers(spark, str(tmp_path / "l.jsonl"))).where("sample_id = 'b'").collect()
    assert [(t.track_id, t.kind, list(t.spans)) for t in tracks] == [("T1", "sfx", [])]
    inferred = lg.inferred_tracks(lg.events_of(src.read_ledgers(spark, str(tmp_path / "l.jsonl")))).where("sample_id = 'a'").first()
    assert inferred.kind == "sfx" and len(inferred.spans) == 3


def test_manifest_conditions_fall_back_to_the_ledger(spark, tmp_path):
    rows = [
        {"scene": {"scene_id": "a", "duration": 12.0, "template": "t", "sources": [{"x": 1}, {"x": 2}], "conditions": {"t60_sec": None, "echo_delay_ms": 120, "codec": "mp3"}}, "target_ledger": {"conditions": {"t60_sec": 0.4, "overlap_ratio": 0.25, "snr_db": 9.0}}},
        {"scene": {"scene_id": "b", "duration": 20.0, "template": "u", "sources": [], "conditions": {"t60_sec": 0.7, "overlap_ratio": 0.1}}, "target_ledger": {"conditions": {"t60_sec": 0.1, "echo": False}}},
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    got = {r.sample_id: r for r in src.conditions_of(src.read_manifest(spark, str(tmp_path / "m.jsonl"))).collect()}
    assert (got["a"].t60_sec, got["a"].overlap_ratio, got["a"].echo, got["a"].source_count, got["a"].snr_db, got["a"].codec) == (0.4, 0.25, "120", 2, 9.0, "mp3")
    assert (got["b"].t60_sec, got["b"].overlap_ratio, got["b"].echo, got["b"].duration, got["b"].template) == (0.7, 0.1, "false", 20.0, "u")


def test_reports_and_strata_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0.5, None), ("a", 1.0, 2)], "sample_id string, event_f1 double, n int")
    src.write_report(rows.agg(F.count("*").alias("n_samples")), rows, str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*")).read_text()
    assert json.loads(text) == {"n_samples": 2, "samples": [{"sample_id": "a", "event_f1": 1.0, "n": 2}, {"sample_id": "b", "event_f1": 0.5, "n": None}]}
    assert {(r.sample_id, r.event_f1) for r in src.read_report(spark, str(tmp_path / "r")).collect()} == {("a", 1.0), ("b", 0.5)}
    strata = spark.createDataFrame([("t60_sec", "<0.3", 4, 0.25), ("t60_sec", "unknown", 1, 1.0), ("echo", "0", 5, 0.5)], "axis string, bucket string, n long, event_f1 double")
    src.write_strata(strata, str(tmp_path / "s"))
    assert json.loads(next((tmp_path / "s").glob("part-*")).read_text())["t60_sec"]["<0.3"] == {"n": 4, "event_f1": 0.25}
    back = src.read_strata(spark, str(tmp_path / "s"), "n:long,event_f1:double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, strata.collect()))
    src.write_json_lines(rows, str(tmp_path / "lines"))
    assert {r.sample_id for r in spark.read.json(str(tmp_path / "lines")).collect()} == {"a", "b"}


def test_sheets_lists_and_maps(spark, tmp_path):
    manifest = spark.createDataFrame([("a", "t", 3.0, "a.wav", ["first"]), ("b", "u", 4.0, "b.wav", [])], "id string, template string, duration double, mixture_path string, texts array<string>")
    manifest = manifest.select(F.struct(F.col("id").alias("scene_id"), "template", "duration").alias("scene"), "mixture_path", F.struct(F.transform("texts", lambda t: F.struct(t.alias("text"))).alias("events")).alias("target_ledger"))
    assert [(r.scene_id, r.n_events, r.first_event_text) for r in src.listen_list(manifest).orderBy("scene_id").collect()] == [("a", 1, "first"), ("b", 0, "")]
    src.write_review_csv(src.listen_list(manifest).coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfscene_id,")
    (tmp_path / "t.txt").write_text("u1 HELLO THERE\nu2\n\n")
    files = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "utterance_id string")
    assert dict(map(tuple, src.with_transcripts(files, src.read_transcripts(spark, str(tmp_path / "t.txt"))).collect())) == {"u1": "HELLO THERE", "u2": "", "u3": ""}
    (tmp_path / "m.json").write_text('{"x.wav": "dog",\n "y.wav": "cat"}')
    assert dict(map(tuple, src.read_json_map(spark, str(tmp_path / "m.json")).collect())) == {"x.wav": "dog", "y.wav": "cat"}
    wide = spark.createDataFrame([("c", "dog", 1.5, None, None)], "clip_id string, source_1_type string, source_1_onset double, source_2_type string, source_2_onset double")
    assert [tuple(r) for r in src.unpivoted_sources(wide, 2, ["type", "onset"]).collect()] == [("c", 1, "dog", "1.5")]


def test_sound_files(spark, tmp_path):
    wave = [math.sin(k / 5) * 0.5 for k in range(800)]
    data = spark.createDataFrame([(wave,)], "w array<double>").select(src.encoded_wav(F.col("w"), 8000).alias("b")).first().b
    (tmp_path / "wavs").mkdir()
    (tmp_path / "wavs/ok.wav").write_bytes(bytes(data))
    (tmp_path / "wavs/bad.wav").write_bytes(b"RIFFnonsense")
    got = {r.path.rsplit("/", 1)[1]: r for r in src.read_audio(spark, str(tmp_path / "wavs"), 8000).collect()}
    assert got["ok.wav"].error is None and got["ok.wav"].wave == pytest.approx(wave, abs=1e-4)
    assert got["bad.wav"].wave is None and got["bad.wav"].error
    half = src.read_audio(spark, str(tmp_path / "wavs/ok.wav"), 4000).first().wave
    assert len(half) == 400 and half[10] == pytest.approx(wave[20], abs=1e-3)
    assert sorted(r.path.rsplit("/", 1)[1] for r in src.listed(spark, str(tmp_path), "*.wav").collect()) == ["bad.wav", "ok.wav"]
