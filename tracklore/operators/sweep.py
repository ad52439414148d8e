"""Evaluation at several thresholds in one pass, with onset collars, and with soft matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import intervals as iv
from ..functions.text import token_f1
from . import match, metrics
from .assign import assigned, assigned_by_level, best_weight
from .staging import dealt

#: Whole tenths that an onset may be off, by the collar's name.
COLLARS = metrics.TOLERANCES


def level_of(confidence: Column, thresholds: list[float]) -> Column:
    """Number of the highest of the ascending thresholds that is at most the confidence, -1 if none is; a null confidence: -1."""
    return reduce(lambda n, t: n + F.coalesce(confidence >= t, F.lit(False)).cast("int"), thresholds, F.lit(-1))


def matched_by_level(block: list[tuple], level: list[int]) -> list[tuple[int, list[int]]]:
    """(level, positions of the rows that match) of a block of `contested`, from the highest level down to 0.

    Predictions that repeat an id at different levels can't be added one after the other;
    such a block is solved anew at each level.
    """
    solved = lambda some: [some[i][0] for i in assigned([x[1] for x in some], [x[2] for x in some])]
    levels = {hyp: level[k] for k, (_, hyp), _ in block}
    if any(level[k] != levels[hyp] for k, (_, hyp), _ in block):
        return [(at, solved([x for x in block if level[x[0]] >= at])) for at in range(max(level[k] for k, _, _ in block), -1, -1)]
    by_level = assigned_by_level([x[1] for x in block], [x[2] for x in block], levels)
    return [(at, [block[i][0] for i in some]) for at, some in zip(range(len(by_level) - 1, -1, -1), by_level, strict=True)]


def solve_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that match at some level, with those levels as `ats`, from rows in order of (sample_id, type)."""

    def matching(rows: pa.Table) -> pa.Table:
        alone, blocks = match.contested(rows)
        level = rows.column("level").to_pylist()
        found = {k: list(range(level[k] + 1)) for k in np.flatnonzero(alone).tolist()}
        for block in (match.told_apart(x, rows) for x in blocks):
            for at, some in matched_by_level(block, level):
                for k in some:
                    found.setdefault(k, []).append(at)
        out = rows.take(pa.array(found, pa.int64()))
        return out.append_column("ats", pa.array(list(found.values()), pa.list_(pa.int32())))

    yield from match.whole_blocks(batches, matching)


def matches_with_levels(refs: DataFrame, hyps: DataFrame, thresholds: list[float], **costs) -> DataFrame:
    """The pairs that match at some threshold, once each, with the numbers of those thresholds as `ats`."""
    active = hyps.withColumn("level", level_of(F.col("confidence"), thresholds)).where("level >= 0")
    pairs = match.gathered(match.candidates(refs, active, carry=("level",), **costs))
    units = match.units(F.col("cost"), "sample_id", "type", "ref_event_id", "hyp_event_id").alias("units")
    marked = pairs.select("sample_id", "type", "ref_event_id", "hyp_event_id", "tiou", "track_match", "cost", "ref_spans", "hyp_spans", "in_block", "level", units)
    return marked.sortWithinPartitions("sample_id", "type").mapInArrow(solve_levels, StructType([*marked.schema, StructField("ats", ArrayType(IntegerType()))])).drop("in_block", "level", "units")


def matches_by_threshold(refs: DataFrame, hyps: DataFrame, thresholds: list[float], **costs) -> DataFrame:
    """The matching pairs at each threshold of the predictions' confidence, numbered by `at`.

    They equal what `match.matches` gives for the predictions from that threshold on. The
    candidates are made once, and each block is solved once: from the highest threshold
    down, predictions are added to the assignment of those above.
    """
    return matches_with_levels(refs, hyps, thresholds, **costs).withColumn("at", F.explode("ats")).drop("ats")


def threshold_metrics(clips: DataFrame, refs: DataFrame, hyps: DataFrame, predicted: DataFrame, thresholds: list[float], **costs) -> DataFrame:
    """`metrics.sample_metrics` of each clip at each threshold of the predictions' confidence.

    `predicted(sample_id)` lists the clips with a prediction, at any threshold. Events move
    once, to their (clip, type), where they are measured once for all thresholds that have
    the same predictions; clips get a row per threshold when all their rows are together.
    """
    thresholds = sorted(thresholds)
    last = len(thresholds) - 1
    by_type = metrics.events_by_type(refs.withColumn("level", F.lit(0)), hyps.withColumn("level", level_of(F.col("confidence"), thresholds)), "level")
    ends = F.array_sort(F.array_distinct(F.concat(F.filter(F.transform("hyp", lambda e: e["level"]), lambda x: x >= 0), F.array(F.lit(last)))))  # the last threshold of each set of predictions
    steps = iv.let(ends, lambda e: F.transform(e, lambda x, i: F.struct(F.coalesce(F.get(e, i - 1) + 1, F.lit(0)).alias("lo"), x.alias("hi"))))
    by_type = by_type.select("*", F.inline(steps)).withColumn("hyp", F.filter("hyp", lambda x: x["level"] >= F.col("lo")))
    pairs = metrics.pair_errors(matches_with_levels(refs, hyps, thresholds, **costs), "ats")
    clip = metrics.by_clip(clips, predicted, metrics.by_type_measures(by_type, "lo", "hi"), pairs).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(last))))
    of_level = {"measures": F.filter("measures", lambda m: F.col("at").between(m["lo"], m["hi"])), "pairs": F.filter("pairs", lambda p: F.array_contains(p["ats"], F.col("at")))}
    named = F.element_at(F.array(*map(F.lit, thresholds)), F.col("at") + 1)
    return metrics.scores(metrics.clip_sums(clip.withColumns(of_level)).withColumn("threshold", named), "threshold")


def corpus_by_threshold(samples: DataFrame) -> DataFrame:
    """`metrics.corpus_metrics` per threshold: means over all clips and total counts."""
    return samples.groupBy("threshold").agg(
        F.count("*").alias("n_samples"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in metrics.MEANS),
        F.sum("hallucination").alias("total_hallucination"), F.sum("omission").alias("total_omission"),
    )


def most_within(refs: Column, hyps: Column, collar: int) -> Column:
    """The most pairs there can be of two ascending arrays of times, each used once, that are at most `collar` apart.

    One walk over both: the earlier of the two next times is of no use to what follows, if
    it is too far from the other.
    """

    def step(state: Column, _: Column, r: Column, h: Column) -> Column:
        a, b = F.get(r, state["i"]), F.get(h, state["j"])
        hit, over = F.abs(a - b) <= collar, a.isNull() | b.isNull()
        on = lambda left, right, n: F.struct((state["i"] + left).alias("i"), (state["j"] + right).alias("j"), (state["n"] + n).alias("n"))
        return F.when(over, state).when(hit, on(1, 1, 1)).when(a < b, on(1, 0, 0)).otherwise(on(0, 1, 0))

    start = F.struct(*(F.lit(0).alias(x) for x in "ijn"))
    walk = lambda r: iv.let(hyps, lambda h: F.aggregate(F.sequence(F.lit(0), F.size(r) + F.size(h)), start, lambda s, k: step(s, k, r, h))["n"])
    return iv.let(refs, walk)


def collar_f1(clips: DataFrame, refs: DataFrame, hyps: DataFrame, collars: dict[str, int] | None = None) -> DataFrame:
    """(sample_id, collar, tp, n_ref, n_hyp, precision, recall, f1): events of one type whose onsets are within the collar match.

    Clips without events get 1; events of other clips are ignored. Rows move once, to
    their clip, in tasks of bounded size.
    """
    collars = collars or COLLARS
    side = lambda df, which: df.select("sample_id", "type", F.lit(which).alias("side"), iv.onset(F.col("spans")).alias("at"))
    times = lambda which: F.array_sort(F.collect_list(F.when(F.col("side") == which, F.col("at")))).alias(which)
    events = side(refs, "ref").unionByName(side(hyps, "hyp"))
    flagged = events.unionByName(clips.select("sample_id", F.lit("clip").alias("side")), allowMissingColumns=True)
    by_type = dealt(flagged, "sample_id", rows=events.count()).groupBy("sample_id", "type").agg(times("ref"), times("hyp"), F.bool_or(F.col("side") == "clip").alias("is_clip"))
    made = by_type.select("sample_id", "is_clip", *(F.size(x).alias(f"n_{x}") for x in ("ref", "hyp")), *(most_within(F.col("ref"), F.col("hyp"), k).alias(f"tp_{name}") for name, k in collars.items()))
    sums = (F.sum(c).alias(c) for c in ("n_ref", "n_hyp", *(f"tp_{name}" for name in collars)))
    clip = made.groupBy("sample_id").agg(F.bool_or("is_clip").alias("is_clip"), *sums).where("is_clip")
    rows = clip.select("sample_id", "n_ref", "n_hyp", F.explode(F.array(*(F.struct(F.lit(name).alias("collar"), F.col(f"tp_{name}").alias("tp")) for name in collars))).alias("x"))
    p, r = (metrics.ratio(F.col("x.tp"), F.col(n)) for n in ("n_hyp", "n_ref"))
    return rows.select("sample_id", "x.collar", "x.tp", "n_ref", "n_hyp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(metrics.f1(p, r), 6).alias("f1"))


def solve_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the matching of greatest weight, from rows in order of (sample_id, type)."""

    def matching(rows: pa.Table) -> pa.Table:
        keep, blocks = match.contested(rows)
        for block in (match.told_apart(x, rows) for x in blocks):
            keep[[block[i][0] for i in best_weight([x[1] for x in block], [x[2] for x in block])]] = True
        return rows.filter(pa.array(keep))

    yield from match.whole_blocks(batches, matching)


def heaviest(pairs: DataFrame, weight: Column) -> DataFrame:
    """The pairs of the matching of greatest total weight per (sample_id, type), ties by a hash of the ids.

    Pairs without weight are left out, as may be others that stand in the way of more.
    `pairs` has ref_event_id and hyp_event_id besides the two keys.
    """
    some = match.gathered(pairs.withColumn("weight", F.round(weight * 1_000_000).cast("long")).where("weight > 0"))
    marked = some.withColumn("units", match.units(F.col("weight") / 1_000_000, "sample_id", "type", "ref_event_id", "hyp_event_id"))
    return marked.sortWithinPartitions("sample_id", "type").mapInArrow(solve_weights, marked.schema).drop("in_block", "units")


def soft_f1(clips: DataFrame, refs: DataFrame, hyps: DataFrame, alpha: float = 1.0, beta: float = 1.0, similarity: Callable[[Column, Column], Column] = token_f1) -> DataFrame:
    """(sample_id, weight, n_ref, n_hyp, soft_precision, soft_recall, soft_f1) per clip.

    The weight of a pair of one type is its text similarity to the power alpha times its
    IoU to the power beta, in millionths; W is the greatest sum that a matching has. Soft
    precision is W / predictions, soft recall W / references; without either they are 1.
    """
    pairs = match.candidates(refs, hyps, least=0.0, similarity=similarity)
    best = heaviest(pairs.select("sample_id", "type", "ref_event_id", "hyp_event_id", "tiou", "text_sim"), F.pow("text_sim", F.lit(alpha)) * F.pow("tiou", F.lit(beta)))
    rows = [
        clips.select("sample_id", F.lit(True).alias("is_clip")), refs.select("sample_id", F.lit(1).alias("n_ref")), hyps.select("sample_id", F.lit(1).alias("n_hyp")), best.select("sample_id", "weight"),
    ]
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    clip = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).groupBy("sample_id").agg(F.bool_or("is_clip").alias("is_clip"), *map(count, ("n_ref", "n_hyp", "weight"))).where("is_clip")
    rounded = lambda part, whole: F.expr(f"(2 * ({part}) + ({whole})) div (2 * ({whole}))") / 1_000_000  # noqa: E731  of whole millionths, half up
    share = lambda part, whole: F.when(F.expr(whole) > 0, rounded(part, whole)).otherwise(F.lit(1.0))
    return clip.select(
        "sample_id", (F.col("weight") / 1_000_000).alias("weight"), "n_ref", "n_hyp",
        share("weight", "n_hyp").alias("soft_precision"), share("weight", "n_ref").alias("soft_recall"), share("2 * weight", "n_ref + n_hyp").alias("soft_f1"),
    )
