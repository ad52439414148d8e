"""Built ledgers, items and slots against worked cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracklore.functions import intervals as iv
from tracklore.operators import building, slots, validate


def test_built_ledger(spark):
    rows = [("c", 1, "speech", [(10, 20), (30, 45)]), ("c", 2, "ambience", [(0, 100)]), ("c", 3, "sfx", [(12, 14), (50, 52)]), ("c", 4, "vocal", []), ("c", 5, "vocal", [(10, 12)])]
    sources = spark.createDataFrame([(*r[:3], f"text {r[1]}", "who", r[3]) for r in rows], f"sample_id string, pos int, kind string, text string, identity string, spans {iv.SPANS}")
    clips = spark.createDataFrame([("c", 100, "t"), ("silent", 50, "t")], "sample_id string, duration_ds int, template string")
    got = {r.sample_id: r for r in building.built_ledgers(clips, sources).collect()}
    events = [(e.id, e.type, e.track_id, [tuple(s) for s in e.spans], e.verbatim, e.confidence) for e in got["c"].events]
    assert events == [
        ("E003", "sfx", "T2", [(0, 100)], None, 0.93), ("E001", "speech", "T1", [(10, 20)], False, 0.95), ("E005", "lys", "T5", [(10, 12)], True, 0.88),
        ("E004", "sfx", "T3", [(12, 14), (50, 52)], None, 0.93), ("E002", "speech", "T1", [(30, 45)], False, 0.95),
    ]
    assert [(t.id, t.kind, [tuple(s) for s in t.spans]) for t in got["c"].tracks][3] == ("T4", "vocal", [(0, 1)])
    assert got["c"].overlap_ratio == pytest.approx(0.27) and got["silent"].events == [] and got["silent"].overlap_ratio == 0
    flat = building.built_events(sources)
    tracks = building.built_tracks(sources)
    none = spark.createDataFrame([], "sample_id string, event_id string, predicate string, target_event_id string")
    assert validate.violations(clips, tracks, flat, none).collect() == []
    item = building.items(building.built_ledgers(clips, sources), F.lit("g"), lyrics=True).where("sample_id = 'silent'").first()
    assert item.target_atomic == "<empty/>" and "style=brief" in item.prompt and "<lys>" in item.prompt


def test_slot_events_and_masks(spark):
    rows = [("a", 0, 0.9, [0.1, 0.6, 0.2, 0.1], [0.0, 0.9, 0.2, 0.7]), ("a", 1, 0.39, [1.0, 0.0, 0.0, 0.0], [1.0]), ("a", 2, 0.4, [0.5, 0.5, 0.0, 0.0], [0.9, 0.1]), ("a", 3, 0.8, [0.0, 0.0, 0.0, 1.0], [0.5, 0.1])]
    df = spark.createDataFrame(rows, "sample_id string, slot int, eventness double, type_probs array<double>, activity array<double>")
    got = [(r.event_id, r.slot, r.type, tuple(r.spans[0])) for r in slots.slot_events(df).orderBy("ord").collect()]
    assert got == [("E001", 0, "lys", (1, 4)), ("E002", 2, "speech", (0, 1))]
    bounds = spark.createDataFrame([("a", 0, 0.5, [0.0, 0.0, 1.0, 0.0], 5, 9), ("a", 1, 0.5, [0.0, 0.0, 1.0, 0.0], 9, 9)], "sample_id string, slot int, eventness double, type_probs array<double>, onset_ds int, offset_ds int")
    assert [tuple(r.spans[0]) for r in slots.slot_events(bounds).collect()] == [(5, 9)]


@pytest.mark.parametrize("masks", [True, False])
def test_slot_assignment_is_optimal(spark, masks):
    r = random.Random(5)
    events, made = [], []
    for c in range(12):
        for k in range(r.randint(0, 4)):
            start = r.randrange(0, 18)
            events.append((f"c{c}", k, r.choice(slots.TYPES), [(start, r.randint(start + 1, 25))]))
        for k in range(4):
            start = r.randrange(0, 18)
            p = [r.random() for _ in range(4)]
            made.append((f"c{c}", k, 0.9, [x / sum(p) for x in p], [float(r.random() < 0.4) for _ in range(20)], start, start + r.randint(1, 6)))
    df = spark.createDataFrame(events, f"sample_id string, ord int, type string, spans {iv.SPANS}").groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type", "spans"))), lambda e: e).alias("events"))
    targets = df.select("sample_id", F.posexplode(slots.slot_targets(F.col("events"), 20, 3)).alias("pos", "target"))
    predicted = spark.createDataFrame(made, "sample_id string, slot int, eventness double, type_probs array<double>, activity array<double>, onset_ds int, offset_ds int")
    costs = slots.slot_costs(predicted.drop("onset_ds", "offset_ds") if masks else predicted.drop("activity"), targets, 20)
    by = {}
    for x in costs.collect():
        by.setdefault(x.sample_id, {})[x.target, x.slot] = x.cost
    got = {}
    for x in slots.slot_assignment(costs).collect():
        got.setdefault(x.sample_id, []).append((x.target, x.slot))
    assert set(got) == set(by)
    for c, table in by.items():
        n = len({t for t, _ in table})
        assert len(got[c]) == n == len({s for _, s in got[c]})
        best = min(sum(table[t, s] for t, s in enumerate(p)) for p in itertools.permutations(range(4), n))
        assert sum(table[p] for p in got[c]) == pytest.approx(best, abs=1e-4)
