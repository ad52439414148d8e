"""Small kernels against brute force and worked cases."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tracklore.functions import intervals
from tracklore.operators import assign, codecs, recovery
from tracklore.streaming import ingest


def test_more_matches_come_before_lower_cost():
    pairs = [("r1", "h1"), ("r1", "h2"), ("r2", "h1"), ("r9", "h9")]
    assert assign.assigned(pairs, [0, 13, 13, 99]) == [1, 2, 3]


@pytest.mark.parametrize("seed", range(20))
def test_block_equals_all_matchings(seed):
    r = random.Random(seed)
    pairs = sorted({(f"r{r.randrange(5)}", f"h{r.randrange(5)}") for _ in range(r.randint(1, 14))})
    cost = [r.randrange(1000) for _ in pairs]
    free = lambda some: len({pairs[k][0] for k in some}) == len({pairs[k][1] for k in some}) == len(some)
    every = [some for n in range(6) for some in itertools.combinations(range(len(pairs)), n) if free(some)]
    best = min(every, key=lambda some: (-len(some), sum(cost[k] for k in some)))
    got = assign.assigned(pairs, cost)
    assert free(got) and (len(got), sum(cost[k] for k in got)) == (len(best), sum(cost[k] for k in best))


def test_merged_spans_equal_brute_force(spark):
    r, rows = random.Random(3), []
    for k in range(60):
        rows.append((k, [(a, a + r.randint(1, 6)) for a in (r.randint(0, 40) for _ in range(r.randint(0, 6)))]))
    df = spark.createDataFrame(rows, f"k int, spans {intervals.SPANS}")
    for gap in (0, 3):
        for row in df.select("spans", intervals.merged(F.col("spans"), gap).alias("m")).collect():
            want: list[list[int]] = []
            for a, b in sorted(map(tuple, row.spans)):
                if want and a - want[-1][1] < gap:
                    want[-1][1] = max(want[-1][1], b)
                else:
                    want.append([a, b])
            assert [list(x) for x in row.m] == want
    for row in df.select("spans", intervals.length(intervals.merged(F.col("spans"))).alias("n")).collect():
        assert row.n == len({t for a, b in row.spans for t in range(a, b)})


LEDGER = {
    "schema_version": codecs.VERSION, "sample_id": "c1", "duration_sec": 10.0, "time_resolution_sec": 0.1, "language": "en",
    "tracks": [{"id": "T1", "kind": "speech", "identity": "A & B", "spans": [{"start_sec": 1.0, "end_sec": 2.5}], "confidence": 0.9}],
    "events": [{"id": "E001", "type": "speech", "track_id": "T1", "spans": [{"start_sec": 1.0, "end_sec": 2.5}], "text": "one < two", "confidence": 0.5, "verbatim": True}],
}


def test_xml_round_trip_and_faults():
    back = codecs.read_xml(codecs.write_xml(LEDGER))
    assert back["sample_id"] == "c1" and back["duration_sec"] == 10.0
    assert back["events"][0]["text"] == "one < two" and back["events"][0]["verbatim"] is True
    assert [(s["start_sec"], s["end_sec"]) for s in back["events"][0]["spans"]] == [(1.0, 2.5)]
    assert back["tracks"][0]["identity"] == "A & B"
    assert codecs.read_xml(codecs.write_xml(LEDGER, "events"))["tracks"] == []
    for bad in ("", "<ledger/>", "<other/>", "no markup"):
        with pytest.raises(ValueError):
            codecs.read_xml(bad)
    with pytest.raises(ValueError):
        codecs.write_xml(LEDGER, "other")


def test_tolerant_reading(spark):
    both = '<music id="E7" t="0-1.5,2-3" track="T2" confidence="0.5">bed</music>'
    texts = [
        None,
        "<empty/>",
        'so: <SFX time="1-2" track_id="T1" verbatim="Yes">bang\n</sfx> <speech t="3-2">x</speech><lys/><lys t="1-2"/> <speech t="a-b">y</speech>',
        both + both.replace("E7", "x") + both,
        '<speech t="1-2" track="T1" confidence="odd">a</speech><lys spans="1.5-4" track="T1">b</lys><speech t="9-12">late</speech>',
        codecs.write_xml(LEDGER),
        "<sfx t='1-2'>single quotes</sfx><sfx t=\"1-2\">   </sfx>",
    ]
    df = spark.createDataFrame([(f"c{i}", t, 10.0, i) for i, t in enumerate(texts)], "sample_id string, text string, duration_sec double, form int").drop("form")
    got = {r.sample_id: r for r in recovery.recovered(df).collect()}
    counts = {k: (r.ok, r.events_recovered, r.events_rejected, r.error) for k, r in got.items()}
    assert counts == {
        "c0": (False, 0, 0, None), "c1": (False, 0, 0, None), "c2": (False, 1, 4, None), "c3": (False, 3, 0, None),
        "c4": (False, 3, 0, "an event ends after the clip"), "c5": (True, 1, 0, None), "c6": (False, 0, 2, None),
    }
    led = {k: json.loads(r.ledger) for k, r in got.items()}
    sfx = led["c2"]["events"][0]
    assert (sfx["type"], sfx["text"], sfx["verbatim"], sfx["confidence"], sfx["track_id"]) == ("sfx", "bang", True, 1.0, "T1")
    assert [e["id"] for e in led["c3"]["events"]] == ["E7", "E001", "E002"]
    assert led["c3"]["tracks"] == [{"id": "T2", "kind": "music", "spans": [{"start_sec": 0.0, "end_sec": 1.5}, {"start_sec": 2.0, "end_sec": 3.0}], "confidence": 0.5}]
    assert led["c4"]["tracks"] == [{"id": "T1", "kind": "residual", "spans": [{"start_sec": 1.0, "end_sec": 4.0}], "confidence": 1.0}]
    assert led["c5"]["sample_id"] == "c5" and led["c5"]["events"][0]["text"] == "one < two"
    assert "no usable confidence: E000" in got["c4"].warnings and "no usable confidence: E000" not in got["c3"].warnings


def test_cascade_reads_time_tokens_first(spark):
    good, late = "<sfx><|t_005|>bang<|t_010|></sfx>", "<sfx><|t_050|>bang<|t_200|></sfx>"
    texts = [good + good, "<empty/>", '<music t="1-2">bed</music>', good + late, codecs.write_xml(LEDGER)]
    df = spark.createDataFrame([(f"c{i}", t, 10.0) for i, t in enumerate(texts)], "sample_id string, text string, duration_sec double")
    read = lambda **kw: [(r.form, r.ok, r.events_recovered) for r in recovery.cascade(df, **kw).orderBy("sample_id").collect()]
    want = [("atomic", True, 2), ("empty", False, 0), ("tolerant", False, 1), ("tolerant", False, 0), ("strict", True, 1)]
    got = read()
    assert got[:3] + got[4:] == want[:3] + want[4:] and got[3] == ("tolerant", False, 0)
    assert read(salvage=True)[3] == ("atomic", True, 1)


def test_stream_writes_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps(LEDGER) + "\nnot a ledger\n")
    stream = ingest.ledger_stream(spark, str(tmp_path / "in"))
    query = ingest.write_batches(stream, lambda df: df.select("sample_id"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert [r.sample_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["c1"]
