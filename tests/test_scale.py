"""What goes wrong on larger tables only, made to happen on small ones."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tracklore.functions import intervals as iv
from tracklore.operators import components, match, speech, staging, sweep, uncertainty, validate
from tracklore.operators.staging import kept


@contextmanager
def conf(spark, **settings):
    """Settings of the session, with __ for each point, for a while."""
    old = {k: spark.conf.get(k) for k in (x.replace("__", ".") for x in settings)}
    for k, v in settings.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_blocks_stay_whole_over_many_partitions(spark, limit):
    clips = spark.range(60).select(F.concat(F.lit("c"), "id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    name = F.concat(F.lit("E"), F.col("n").cast("string"))
    events = clips.select("sample_id", name.alias("event_id"), F.col("n").cast("long").alias("ord"), F.lit("sfx").alias("type"), F.lit("T1").alias("track_id"), F.lit("x").alias("text"), F.array(iv.span(F.lit(10), 40 + 10 * F.col("n"))).alias("spans"))
    turns = events.select("sample_id", F.col("event_id").alias("speaker"), "spans")
    with conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold=limit, spark__sql__shuffle__partitions="7"):
        mapped = speech.mapped_speakers(turns, turns).select("sample_id", F.col("ref_speaker").alias("ref"), F.col("hyp_speaker").alias("hyp"))
        matched = match.matches(match.candidates(events, events)).select("sample_id", F.col("ref_event_id").alias("ref"), F.col("hyp_event_id").alias("hyp"))
        for found in (mapped, matched):
            assert sorted(map(tuple, found.collect())) == sorted((f"c{c}", f"E{k}", f"E{k}") for c in range(60) for k in range(4))
        assert all(x.der == 0 and x.jer == 0 for x in speech.diarization(turns, turns).collect())


def test_rounds_of_components_plan_in_constant_time(spark):
    """Halves of chains that meet round by round: what one round knows of its rows isn't handed to the next."""
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)] + [(i + 1, f"p{i}") for i in range(39)], "clip long, path string")
    df = rows.select("clip", F.col("clip").alias("same")).where("clip >= 0 AND clip = same")
    left = kept(df)._jdf.queryExecution().optimizedPlan().constraints()
    assert left.isEmpty()
    assert {x.component for x in components.clip_components(rows, "clip", "path").collect()} == {0}


def test_repeated_spans_unite_as_single_ones(spark):
    for gap, want in ((0, [(35, 40), (40, 75), (80, 90)]), (1, [(35, 75), (80, 90)])):
        rows = spark.createDataFrame([([(80, 90), (40, 75), (35, 40)] * n,) for n in (1, 6, 60)], f"spans {iv.SPANS}")
        assert [[tuple(s) for s in x.u] for x in rows.select(iv.merged(F.col("spans"), gap).alias("u")).collect()] == [want] * 3


def test_a_draw_is_hashed_once(spark):
    rows = spark.range(5).select(F.col("id").alias("sample_id"), F.col("id").cast("double").alias("m"))
    plan = uncertainty.bootstrap(rows, ["m"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_an_edit_distance_is_computed_once(spark):
    turns = spark.createDataFrame([("c", "a", 1, "one two"), ("c", "b", 2, "three")], "sample_id string, speaker string, pos long, text string")
    found = speech.cpwer(turns, turns)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1
    assert [tuple(x) for x in found.collect()] == [("c", 3, 0, 0.0)]


def clip_events(spark, n):
    """Two tables of n events each, five a clip, the second one a tenth later."""
    rows = lambda late: [(f"c{i // 5}", f"E{i}", i, "speech", "T1", "x", 0.9, [(10 * (i % 5) + late, 10 * (i % 5) + 8 + late)]) for i in range(n)]
    schema = "sample_id string, event_id string, ord long, type string, track_id string, text string, confidence double, spans array<struct<start_ds int, end_ds int>>"
    return spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema)


def test_collars_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    refs, hyps = clip_events(spark, 600)
    clips = refs.select("sample_id").distinct()
    whole = sorted(map(tuple, sweep.collar_f1(clips, refs, hyps).collect()))
    monkeypatch.setattr(staging, "TASK_ROWS", 30)
    dealt = sweep.collar_f1(clips, refs, hyps)
    assert dealt.rdd.getNumPartitions() >= 40
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == 120 * len(sweep.COLLARS)


def test_violations_are_found_in_tasks_of_bounded_size(spark, monkeypatch):
    events, _ = clip_events(spark, 600)
    events = events.withColumn("event_id", F.when(F.col("ord") % 50 == 1, F.concat(F.lit("E"), (F.col("ord") - 1).cast("string"))).otherwise(F.col("event_id")))
    events = events.withColumn("track_id", F.when(F.col("ord") % 60 == 3, "T9").otherwise(F.col("track_id")))
    clips = events.select("sample_id").distinct().withColumn("duration_ds", F.lit(45))
    tracks = events.where("track_id = 'T1'").select("sample_id", "track_id", F.lit("speech").alias("kind"), "confidence", F.array(F.element_at("spans", 1)).alias("spans")).where("ord % 5 = 0")
    relations = events.where("ord % 40 = 0").select("sample_id", "event_id", F.lit("before").alias("predicate"), F.lit("E0x").alias("target_event_id"))
    whole = sorted(map(tuple, validate.violations(clips, tracks, events, relations).collect()))
    count = lambda rule: sum(x[1] == rule for x in whole)
    assert (count("event_repeated"), count("event_track"), count("relation_target"), count("event_outside"), len(whole)) == (12, 10, 15, 120, 157)
    monkeypatch.setattr(staging, "TASK_ROWS", 30)
    for df, rows in ((validate.repeated_ids(events, "event_id"), 12), (validate.dangling_tracks(events, tracks), 10), (validate.outside_clip(events, clips), 120)):
        assert df.rdd.getNumPartitions() >= 20 and df.count() == rows
    assert sorted(map(tuple, validate.violations(clips, tracks, events, relations).collect())) == whole
