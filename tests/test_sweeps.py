"""Sweeps, collars and soft matches against separate runs and enumeration."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklore.functions import intervals as iv
from tracklore.operators import match, metrics, sweep

EVENTS = f"sample_id string, event_id string, ord long, type string, track_id string, text string, confidence double, spans {iv.SPANS}"


def events(seed, n, prefix, hot=0):
    """Random events of a few clips; `hot` more of one clip and type, where much overlaps."""
    r = random.Random(seed)
    rows = []
    for i in range(n + hot):
        clip, kind = ("c0", "sfx") if i >= n else (f"c{r.randrange(6)}", r.choice(["sfx", "speech"]))
        at = r.randrange(60 if i < n else 40)
        rows.append((clip, f"{prefix}{i}", i, kind, r.choice(["T1", "T2", None]), r.choice(["a b", "b", "c"]), r.choice([0.1, 0.3, 0.5, 0.9, None]), [(at, at + r.randint(1, 15))]))
    return rows


@pytest.fixture(scope="module")
def both(spark):
    return spark.createDataFrame(events(1, 50, "r", 25), EVENTS).cache(), spark.createDataFrame(events(2, 50, "h", 25), EVENTS).cache()


def test_all_thresholds_equal_a_run_each(spark, both):
    refs, hyps = both
    thresholds = [0.05, 0.3, 0.5, 0.95]
    clips, predicted = refs.select("sample_id").distinct(), hyps.select("sample_id").distinct()
    got = sweep.threshold_metrics(clips, refs, hyps, predicted, thresholds)
    total = 0
    for t in thresholds:
        some = hyps.where(F.col("confidence") >= t)
        want = metrics.sample_metrics(clips, refs, some, predicted)
        assert sorted(map(str, got.where(F.col("threshold") == t).drop("threshold").collect())) == sorted(map(str, want.collect()))
        total += want.agg(F.sum("n_matched")).first()[0]
    assert total > 60
    assert sweep.corpus_by_threshold(got).count() == len(thresholds)


def test_collars_find_the_most_pairs(spark):
    r = random.Random(3)
    rows = [(sorted(r.randrange(30) for _ in range(r.randint(0, 6))), sorted(r.randrange(30) for _ in range(r.randint(0, 6)))) for _ in range(80)]
    df = spark.createDataFrame(rows, "r array<int>, h array<int>")
    for x in df.select("r", "h", *(sweep.most_within(F.col("r"), F.col("h"), k).alias(f"n{k}") for k in (0, 2, 5))).collect():
        for k in (0, 2, 5):
            few, many = sorted((x.r, x.h), key=len)
            most = max(sum(abs(a - b) <= k for a, b in zip(few, p)) for p in itertools.permutations(many, len(few)))
            assert x[f"n{k}"] == most
    refs = spark.createDataFrame([("a", "r1", 1, "sfx", None, "x", 1.0, [(3, 5)])], EVENTS)
    got = {(x.sample_id, x.collar): x for x in sweep.collar_f1(spark.createDataFrame([("a",), ("b",)], "sample_id string"), refs, refs.withColumn("spans", F.array(iv.span(F.lit(5), F.lit(6))))).collect()}
    assert got["a", "010"].f1 == 0 and got["a", "025"].f1 == 1 and got["b", "010"].f1 == 1 and len(got) == 8


def test_soft_matches_have_the_greatest_weight(spark, both):
    refs, hyps = both
    pairs = match.candidates(refs, hyps, least=0.0).where("text_sim > 0").collect()
    best = sweep.soft_f1(refs.select("sample_id").distinct(), refs, hyps, 1.0, 1.0)
    got = {x.sample_id: x for x in best.collect()}
    from tracklore.operators import assign

    for clip, x in got.items():
        total = 0
        for kind in ("sfx", "speech"):
            block = [p for p in pairs if p.sample_id == clip and p.type == kind]
            weight = [round(p.text_sim * p.tiou * 1e6) for p in block]
            total += sum(weight[k] for k in assign.best_weight([(p.ref_event_id, p.hyp_event_id) for p in block], weight))
        assert x.weight == pytest.approx(total / 1e6, abs=2e-6)
        assert x.soft_precision == pytest.approx(x.weight / x.n_hyp, abs=1e-6)


def test_blocks_are_whole_across_batches(spark, both):
    refs, hyps = both
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(str, match.matches(match.candidates(refs, hyps)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, match.matches(match.candidates(refs, hyps)).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def operators(df):
    """The lines of the physical plan, the last step first."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").splitlines()


def test_levels_are_unfolded_after_the_last_shuffle(spark, both):
    refs, hyps = both
    ids = refs.select("sample_id").distinct()
    plan = operators(sweep.threshold_metrics(ids, refs, hyps, ids, [0.05, 0.3, 0.5]))
    unfolded = [i for i, x in enumerate(plan) if "explode(" in x]
    assert len(unfolded) == 1 and unfolded[0] < next(i for i, x in enumerate(plan) if "Exchange" in x)  # a row per level would be shuffled otherwise


def test_a_pair_comes_once_with_its_levels(spark, both):
    refs, hyps = both
    thresholds = [0.05, 0.3, 0.5, 0.95]
    once = sweep.matches_with_levels(refs, hyps, thresholds).collect()
    assert len({(p.sample_id, p.type, p.ref_event_id, p.hyp_event_id) for p in once}) == len(once) > 20
    for at, t in enumerate(thresholds):
        want = match.matches(match.candidates(refs, hyps.where(F.col("confidence") >= t))).collect()
        assert sorted((p.sample_id, p.ref_event_id, p.hyp_event_id) for p in once if at in p.ats) == sorted((p.sample_id, p.ref_event_id, p.hyp_event_id) for p in want)


def test_matching_sorts_pairs_once(spark, both):
    refs, hyps = both
    plan = operators(metrics.sample_metrics(refs, refs, hyps, hyps))
    assert sum("Window [" in x for x in plan) == 1 and sum("Sort [" in x for x in plan) <= 3  # the two sides of the join, and their pairs if the join leaves no order


def test_null_spans_and_types_and_repeated_ids(spark):
    row = lambda clip, e, kind, track, *spans: (clip, e, 1, kind, track, "a", 0.9, list(spans) if spans[:1] != (None,) else None)
    refs = spark.createDataFrame([row("a", "r1", "sfx", "T1", (0, 10)), row("a", "r2", "sfx", None, None), row("a", "r3", None, "T2", (5, 9)), row("b", "r1", "sfx", "T1", (0, 4), (6, 9)), row("b", "r1", "sfx", "T1", (0, 4))], EVENTS)
    hyps = spark.createDataFrame([row("a", "h1", "sfx", "T1", (1, 10)), row("a", "h2", None, "T3", (5, 5)), row("b", "h1", "sfx", "T1", (0, 4), (6, 9)), row("z", "h1", "sfx", "T1", (0, 4))], EVENTS)
    ids = refs.select("sample_id").distinct()
    got = {x.sample_id: x for x in metrics.sample_metrics(ids, refs, hyps, hyps).collect()}
    assert set(got) == {"a", "b"} and (got["a"].n_ref, got["a"].n_hyp, got["a"].n_matched, got["b"].n_ref, got["b"].n_matched) == (3, 2, 1, 2, 1)
    assert got["a"].seg_f1_100ms == pytest.approx(round(2 * 9 / (2 * 9 + 1 + 4), 6)) and got["a"].source_count_mae == 0 and got["a"].onset_p90 == 0.1 and got["b"].onset_mae == 0
    swept = {x.sample_id: x for x in sweep.threshold_metrics(ids, refs, hyps, hyps, [0.5]).drop("threshold").collect()}
    assert swept == got


@pytest.mark.parametrize("order", list(itertools.permutations(range(4))))
def test_repeated_ids_match_alike_in_any_order_of_rows(order):
    spans = [[(0, 4), (6, 9)], [(0, 4)], [(0, 3), (4, 5)], [(1, 5)]]  # the last three are equally good
    rows = [{"sample_id": "b", "type": "sfx", "ref_event_id": "r1", "hyp_event_id": "h1", "units": min(k, 1), "level": 1, "ref_spans": [{"start_ds": a, "end_ds": b} for a, b in spans[k]]} for k in range(4)]
    given = lambda some: [pa.RecordBatch.from_pylist(some)]
    mixed = [rows[k] for k in order]
    assert [x["ref_spans"] for b in match.solve(given(mixed)) for x in b.to_pylist()] == [rows[0]["ref_spans"]]
    assert [(x["ref_spans"], x["ats"]) for b in sweep.solve_levels(given(mixed)) for x in b.to_pylist()] == [(rows[0]["ref_spans"], [1, 0])]
    equal = [x for x in mixed if x["units"]]
    assert [x["ref_spans"] for b in match.solve(given(equal)) for x in b.to_pylist()] == [rows[2]["ref_spans"]]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_predictions_that_repeat_an_id_at_two_levels(order):
    pairs = [("r1", "h1", 5, 1), ("r1", "h1", 1, 0), ("r2", "h1", 2, 0)]
    rows = [{"sample_id": "a", "type": "sfx", "ref_event_id": r, "hyp_event_id": h, "units": cost, "level": level, "ref_spans": []} for r, h, cost, level in (pairs[k] for k in order)]
    got = [(x["units"], at) for b in sweep.solve_levels([pa.RecordBatch.from_pylist(rows)]) for x in b.to_pylist() for at in x["ats"]]
    for at in range(2):
        want = match.solve([pa.RecordBatch.from_pylist([x for x in rows if x["level"] >= at])])
        assert [u for u, level in got if level == at] == [x["units"] for b in want for x in b.to_pylist()]


def test_percentile_of_an_array_is_that_of_rows(spark):
    r = random.Random(5)
    lists = [[], [3], [1, 2]] + [[r.randrange(40) for _ in range(r.randint(1, 25))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, x array<int>")
    one = {x.i: x.p for x in df.select("i", metrics.upper_tenth(F.col("x")).alias("p")).collect()}
    want = {x.i: x.p for x in df.select("i", F.explode_outer("x").alias("v")).groupBy("i").agg(F.percentile("v", F.lit(0.9)).alias("p")).collect()}
    assert one == pytest.approx(want)
