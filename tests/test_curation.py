"""Components, edits, quotas, voting and reliability on small cases."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracklore.functions import intervals as iv
from tracklore.operators import components, dataset, revisions, uncertainty


def test_components_equal_union_find(spark):
    r = random.Random(1)
    rows = [(r.randrange(80), f"p{r.randrange(70)}") for _ in range(90)] + [(i, f"chain{i // 2}") for i in range(100, 160)] + [(i + 1, f"chain{i // 2 + 500}") for i in range(101, 160, 2)] + [(i, f"chain{(i + 1) // 2 + 900}") for i in range(101, 159)]
    rows += [(500, None), (None, "p1"), (0, "hot")] + [(i, "hot") for i in range(600, 800)] + rows[:5]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for c, p in rows:
        if c is not None:
            find(("c", c))
            if p is not None:
                top[find(("c", c))] = find(("p", p))
    least = {}
    for c in {c for c, _ in rows if c is not None}:
        least.setdefault(find(("c", c)), []).append(c)
    df = spark.createDataFrame(rows, "clip long, path string")
    got = {x.clip: x.component for x in components.clip_components(df, "clip", "path").collect()}
    assert got == {c: min(some) for some in least.values() for c in some}
    split = components.component_split(df, "clip", "path", 0.4, "s")
    assert components.crossing_paths(df, split, "clip", "path").count() == 0 and split.count() == len(got)
    unsound = split.withColumn("split", F.when(F.col("clip") % 2 == 0, "a").otherwise("b"))
    assert components.crossing_paths(df, unsound, "clip", "path").where("path = 'hot'").count() == 1
    assert components.clip_components(df.limit(0), "clip", "path").count() == 0


EVENTS = f"sample_id string, event_id string, type string, track_id string, text string, confidence_mils int, spans {iv.SPANS}"
LOG = f"sample_id string, event_id string, seq int, op string, by int, event {revisions.EVENT}, audibility double"


def test_edits_can_be_taken_back_and_faults_are_named(spark):
    e1, e2 = ("sfx", "T1", "bang", 900, [(5, 9)]), ("music", None, "tune", 800, [(0, 3), (7, 9)])
    events = spark.createDataFrame([("c", "E1", *e1), ("c", "E2", *e2)], EVENTS)
    log = revisions.gated(spark.createDataFrame([
        ("c", "E1", 1, "SHIFT", 3, None, None), ("c", "E1", 2, "DEGRADE", 100, None, None), ("c", "E1", 3, "SHIFT", -1, None, None), ("c", "E2", 4, "REMOVE", 0, e2, None),
        ("c", "E3", 5, "ADD", 0, e1, 0.9), ("c", "E3", 6, "SHIFT", 1, None, None), ("c", "E4", 7, "ADD", 0, e1, 0.1), ("c", "E5", 8, "ADD", 0, e1, 0.5), ("c", "E6", 9, "ADD", 0, e1, None),
    ], LOG), 0.3, 0.6)
    assert {x.event_id: x.target for x in log.where("op = 'ADD'").collect()} == {"E3": "must_add", "E4": "must_not_add", "E5": "ignore", "E6": "ignore"}
    made = revisions.edited(events, revisions.effective(log))
    got = {x.event_id: (x.confidence_mils, [tuple(s) for s in x.spans]) for x in made.collect()}
    assert got == {"E1": (800, [(7, 11)]), "E3": (900, [(6, 10)])}
    back = revisions.edited(made, revisions.inverted(revisions.effective(log)))
    assert sorted(map(str, back.select(events.columns).collect())) == sorted(map(str, events.collect()))
    for fault in (("c", "E9", 1, "SHIFT", 1, None, None), ("c", "E1", 1, "ADD", 0, e1, 1.0)):
        with pytest.raises(PySparkException):
            revisions.edited(events, spark.createDataFrame([fault], LOG)).collect()


def test_locked_changes_treat_null_as_a_value(spark):
    kinds = f"sample_id string, event_id string, type string, track_id string, verbatim boolean, text string, spans {iv.SPANS}"
    before = spark.createDataFrame([("c", "E1", "sfx", None, None, "x", [(1, 2)]), ("c", "E2", "sfx", "T1", None, "x", [(1, 2), (5, 6)]), ("c", "E3", "sfx", "T1", None, "x", [(1, 2)])], kinds)
    after = spark.createDataFrame([("c", "E1", "sfx", None, None, "new words", [(1, 2)]), ("c", "E2", "sfx", None, True, "x", [(5, 6), (1, 2)]), ("c", "E4", "sfx", "T1", None, "x", [(1, 2)])], kinds)
    got = {(x.event_id, x.path, x.before, x.after, x.rule) for x in revisions.locked_changes(before, after).collect()}
    assert got == {("E2", "events.track_id", "T1", None, "changed_field"), ("E2", "events.verbatim", None, "true", "changed_field"), ("E3", "events", None, None, "lost_event"), ("E4", "events", None, None, "new_event")}


def test_votes_and_quotas(spark):
    spans = spark.createDataFrame([("c", "sfx", "a", [(0, 10), (5, 12)]), ("c", "sfx", "b", [(8, 20)]), ("c", "sfx", "v", [(0, 9)]), ("c", "sfx", "b", [(20, 25)]), ("c", "sfx", "a", [(20, 22)])], f"sample_id string, type string, teacher string, spans {iv.SPANS}")
    find = lambda **k: sorted((x.start_ds, x.end_ds, x.support) for x in revisions.supported_spans(spans, 2, **k).collect())
    assert find() == [(0, 12, 3), (20, 22, 2)]
    assert find(voters=("a", "b")) == [(8, 12, 3), (20, 22, 2)]
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 5}") for i in range(300)] + [(7, "hot")] * 4, "k long, stratum string")
    for bins in (2, 1 << 14):
        got = dataset.fill_quotas(rows, "stratum", {"hot": 50, "s0": 7, "s1": 1000, "none": 3}, "k", "q", bins)
        assert {x.stratum: x["count"] for x in got.groupBy("stratum").count().collect()} == {"hot": 50, "s0": 7, "s1": 20}
        order = [x.k for x in rows.where("stratum = 's0'").orderBy(dataset.uniform(F.col("k").cast("string"), "q")).limit(7).collect()]
        assert sorted(x.k for x in got.where("stratum = 's0'").collect()) == sorted(order)


def test_reliability_doesnt_depend_on_partitions(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(f"c{i}", r.random(), r.random(), r.choice([0.1, 0.2, 0.9, r.random(), None]), r.random() < 0.5) for i in range(400)], "sample_id string, a double, b double, confidence double, correct boolean")
    for make in (lambda x: uncertainty.bootstrap(x, ["a", "b"], 30), lambda x: uncertainty.paired_permutation(x, "a", "b", 50), uncertainty.calibration_bins, uncertainty.risk_coverage):
        assert sorted(map(str, make(rows.repartition(1)).collect())) == sorted(map(str, make(rows.repartition(7)).collect()))
    kept = sorted((x for x in rows.collect() if x.confidence is not None), key=lambda x: x.confidence)
    curve = {x.n: x.risk for x in uncertainty.risk_coverage(rows).collect()}
    for n, risk in curve.items():
        assert risk == pytest.approx(sum(not x.correct for x in kept[-n:]) / n, abs=1e-6)
    one = uncertainty.calibration(rows).first()
    assert one.n == len(kept) and one.brier == pytest.approx(sum((round(x.confidence, 6) - x.correct) ** 2 for x in kept) / len(kept), abs=1e-6)
    means = uncertainty.bootstrap(rows, ["a"], 200).first()
    assert means.low < means.mean < means.high and 0.03 < means.high - means.low < 0.09
