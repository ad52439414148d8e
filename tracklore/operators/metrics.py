"""Evaluation: per-clip metrics, corpus aggregates and strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.text import TYPES
from . import match

TOLERANCES = {"010": 1, "025": 2, "050": 5, "100": 10}  # whole tenths that are within the tolerance
MEANS = [
    "event_precision", "event_recall", "event_f1", "seg_f1_100ms", "onset_mae", "offset_mae", "onset_p90", "offset_p90",
    *(f"tolerance_acc_{t}" for t in TOLERANCES), "source_count_mae", "pointer_accuracy",
]


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def type_measures(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """Per clip and type the tenths that both, only predictions and only references cover: tp, fp, fn."""
    side = lambda df, which: df.select("sample_id", "type", F.lit(which).alias("side"), "spans")
    united = lambda which: iv.merged(F.flatten(F.collect_list(F.when(F.col("side") == which, F.col("spans")))))
    both = side(refs, "ref").unionByName(side(hyps, "hyp")).groupBy("sample_id", "type").agg(united("ref").alias("r"), united("hyp").alias("h"))
    both = both.withColumn("tp", iv.common(F.col("r"), F.col("h")))
    return both.select("sample_id", "type", "tp", (iv.length(F.col("h")) - F.col("tp")).alias("fp"), (iv.length(F.col("r")) - F.col("tp")).alias("fn"))


def segment_f1(measures: DataFrame) -> DataFrame:
    """Per clip precision, recall and F1 over tenths, summed over types; a clip without any has no row."""
    s = measures.groupBy("sample_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("sample_id", "tp", "fp", "fn", F.round(p, 6).alias("seg_precision"), F.round(r, 6).alias("seg_recall"), F.round(f1(p, r), 6).alias("seg_f1_100ms"))


def boundary_errors(matched: DataFrame) -> DataFrame:
    """Per clip of the matched pairs: mean and 90th percentile of onset and offset errors in seconds, shares within tolerances."""
    on = F.abs(iv.onset(F.col("ref_spans")) - iv.onset(F.col("hyp_spans")))
    off = F.abs(iv.offset(F.col("ref_spans")) - iv.offset(F.col("hyp_spans")))
    m = matched.select("sample_id", on.alias("on"), off.alias("off"), "track_match")
    within = lambda k: F.avg(((F.col("on") <= k) & (F.col("off") <= k)).cast("double"))
    return m.groupBy("sample_id").agg(
        F.count("*").alias("n_matched"),
        F.round(F.avg("on") / 10, 6).alias("onset_mae"),
        F.round(F.avg("off") / 10, 6).alias("offset_mae"),
        F.round(F.percentile("on", F.lit(0.9)) / 10, 6).alias("onset_p90"),
        F.round(F.percentile("off", F.lit(0.9)) / 10, 6).alias("offset_p90"),
        *(F.round(within(k), 6).alias(f"tolerance_acc_{t}") for t, k in TOLERANCES.items()),
        F.round(F.avg(F.col("track_match").cast("double")), 6).alias("pointer_accuracy"),
    )


def per_type(refs: DataFrame, hyps: DataFrame, matched: DataFrame) -> DataFrame:
    """Per clip and type: tp, fp, fn, precision, recall, f1."""
    t = match.event_matches(refs, hyps, matched).groupBy("sample_id", "type").agg(
        F.count_if("is_match").alias("tp"), F.count_if(F.col("ref_id").isNull()).alias("fp"), F.count_if(F.col("hyp_id").isNull()).alias("fn")
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select("sample_id", "type", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def macro_per_type(by_type: DataFrame) -> DataFrame:
    """Means of `per_type` over the clips in which a type occurs."""
    return by_type.groupBy("type").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))


def sample_metrics(clips: DataFrame, refs: DataFrame, hyps: DataFrame, predicted: DataFrame, matched: DataFrame | None = None, ref_tracks: DataFrame | None = None, hyp_tracks: DataFrame | None = None) -> DataFrame:
    """One row per clip of `clips(sample_id)`: counts, F1s, boundary errors, hallucinations, omissions.

    `predicted(sample_id)` lists the clips that have a prediction, an empty one included;
    the others get zeros and `has_prediction` false. Predictions for other clips are
    ignored. `ref_tracks` and `hyp_tracks` have (sample_id, n_tracks); without them the
    distinct tracks of the events count. Without a matched pair errors are 0 and
    tolerances and pointer accuracy 1.

    Events meet once by (clip, type); what they give meets the matched pairs and the clips
    in one aggregation by clip.
    """
    matched = match.matches(match.candidates(refs, hyps)) if matched is None else matched
    measures = by_type_measures(events_by_type(refs, hyps))
    counted = {"ref": ref_tracks, "hyp": hyp_tracks}
    tracks = {f"n_{x}_tracks": df.select("sample_id", F.col("n_tracks").alias(f"n_{x}_tracks")) for x, df in counted.items() if df is not None}
    clip = by_clip(clips, predicted, measures, pair_errors(matched), tracks)
    return scores(clip_sums(clip, *tracks))


def events_by_type(refs: DataFrame, hyps: DataFrame, *more: str) -> DataFrame:
    """(sample_id, type, ref, hyp): the events of both sides as lists of (spans, track_id and `more` columns)."""
    side = lambda df, is_ref: df.select("sample_id", "type", F.struct(F.lit(is_ref).alias("is_ref"), "spans", "track_id", *more).alias("event"))
    lists = side(refs, True).unionByName(side(hyps, False)).groupBy("sample_id", "type").agg(F.collect_list("event").alias("events"))
    return lists.select("sample_id", "type", F.filter("events", lambda e: e["is_ref"]).alias("ref"), F.filter("events", lambda e: ~e["is_ref"]).alias("hyp"))


def by_type_measures(by_type: DataFrame, *keys: str) -> DataFrame:
    """(sample_id, measure): of each row's lists `ref` and `hyp` the `keys`, the tenths tp, fp, fn, the numbers of events and the distinct tracks."""
    spans = lambda x: F.flatten(F.transform(x, lambda e: F.coalesce(e["spans"], iv.none())))
    rows = by_type.withColumns({f"{x}_spans": iv.merged(spans(x)) for x in ("ref", "hyp")}).withColumn("tp", iv.common(F.col("ref_spans"), F.col("hyp_spans")))
    tracks = lambda x: F.filter(F.array_distinct(F.transform(x, lambda e: e["track_id"])), lambda t: t.isNotNull()).alias(f"{x}_tracks")
    rest = lambda x: iv.length(F.col(f"{x}_spans")) - F.col("tp")
    return rows.select("sample_id", F.struct(*keys, "tp", rest("hyp").alias("fp"), rest("ref").alias("fn"), *(F.size(x).alias(f"n_{x}") for x in ("ref", "hyp")), *map(tracks, ("ref", "hyp"))).alias("measure"))


def pair_errors(matched: DataFrame, *keys: str) -> DataFrame:
    """(sample_id, pair): of matched pairs the `keys`, the errors of both ends and whether the track matches."""
    gap = lambda end: F.abs(end(F.col("ref_spans")) - end(F.col("hyp_spans")))
    return matched.select("sample_id", F.struct(*keys, gap(iv.onset).alias("on"), gap(iv.offset).alias("off"), "track_match").alias("pair"))


def by_clip(clips: DataFrame, predicted: DataFrame, measures: DataFrame, pairs: DataFrame, numbers: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per clip: whether it `has` a prediction, its `measures` and `pairs` as lists, and the greatest of each of the `numbers`.

    Lists of small rows move instead of partial sums of each metric, which are wider.
    """
    flag = lambda df, name: df.select("sample_id").distinct().withColumn(name, F.lit(True))
    rows = [measures, pairs, flag(clips, "is_clip"), flag(predicted, "has_prediction"), *(numbers or {}).values()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).groupBy("sample_id").agg(
        F.bool_or("is_clip").alias("is_clip"), F.coalesce(F.bool_or("has_prediction"), F.lit(False)).alias("has"), F.collect_list("measure").alias("measures"), F.collect_list("pair").alias("pairs"),
        *(F.coalesce(F.max(n), F.lit(0)).alias(n) for n in numbers or {}),
    ).where("is_clip").drop("is_clip")


def mean(values: Column) -> Column:
    """Mean of an array of numbers without nulls; null if it is empty."""
    return iv.let(values, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda n, v: n + v) / F.size(x)))


def upper_tenth(values: Column) -> Column:
    """The 90th percentile of an array of numbers without nulls, between its two neighbours as `percentile` has it; null if it is empty."""
    at = lambda x: (F.size(x) - 1) * 0.9
    below = lambda x: F.floor(at(x)).cast("int")
    one = lambda x: (below(x) + 1 - at(x)) * F.get(x, below(x)) + (at(x) - below(x)) * F.coalesce(F.get(x, below(x) + 1), F.lit(0))
    return iv.let(F.array_sort(values), lambda x: F.when(F.size(x) > 0, one(x)))


def clip_sums(clip: DataFrame, *known: str) -> DataFrame:
    """The rows of `by_clip` with the sums and means that `scores` takes; counts of tracks that are `known` stay."""
    known_ = lambda x: f"n_{x}_tracks" in known
    total = lambda c: F.aggregate("measures", F.lit(0).cast("long"), lambda n, m: n + m[c]).alias(c)
    tracks = lambda x: F.col(f"n_{x}_tracks") if known_(x) else F.size(F.array_distinct(F.flatten(F.transform("measures", lambda m: m[f"{x}_tracks"])))).alias(f"n_{x}_tracks")
    of = lambda value: F.filter(F.transform("pairs", value), lambda v: v.isNotNull())
    error = lambda end: of(lambda p: p[end])
    within = lambda k: of(lambda p: F.when(p["on"].isNotNull(), ((p["on"] <= k) & (p["off"] <= k)).cast("double")))
    return clip.select(
        *(c for c in clip.columns if c not in ("measures", "pairs", *known)), F.size(error("on")).cast("long").alias("n_matched"), *map(total, ("n_ref", "n_hyp", "tp", "fp", "fn")), *map(tracks, ("ref", "hyp")),
        *(mean(error(end)).alias(f"{name}_mae") for name, end in (("onset", "on"), ("offset", "off"))), *(upper_tenth(error(end)).alias(f"{name}_p90") for name, end in (("onset", "on"), ("offset", "off"))),
        *(mean(within(k)).alias(f"tolerance_acc_{t}") for t, k in TOLERANCES.items()), mean(of(lambda p: p["track_match"].cast("double"))).alias("pointer_accuracy"),
    )


def scores(clip: DataFrame, *keys: str) -> DataFrame:
    """The metrics of clips from their sums and means, with `keys` in front."""
    n = F.col
    p, r = ratio(n("n_matched"), n("n_hyp")), ratio(n("n_matched"), n("n_ref"))
    sp, sr = ratio(n("tp"), n("tp") + n("fp")), ratio(n("tp"), n("tp") + n("fn"))
    given = lambda c: F.when(n("has"), F.round(c, 6)).otherwise(0.0)
    scored = lambda c, empty: given(F.coalesce(c, F.lit(empty)))
    return clip.select(
        *keys, "sample_id", n("has").alias("has_prediction"), "n_ref", "n_hyp", "n_matched", given(p).alias("event_precision"), given(r).alias("event_recall"), given(f1(p, r)).alias("event_f1"), given(f1(sp, sr)).alias("seg_f1_100ms"),
        *(scored(n(c) / 10, 0.0).alias(c) for c in ("onset_mae", "offset_mae", "onset_p90", "offset_p90")), *(scored(n(f"tolerance_acc_{t}"), 1.0).alias(f"tolerance_acc_{t}") for t in TOLERANCES),
        (n("n_hyp") - n("n_matched")).alias("hallucination"), (n("n_ref") - n("n_matched")).alias("omission"),
        F.abs(n("n_ref_tracks") - n("n_hyp_tracks")).cast("double").alias("source_count_mae"), scored(n("pointer_accuracy"), 1.0).alias("pointer_accuracy"),
    )


def corpus_metrics(samples: DataFrame) -> DataFrame:
    """One row: means over all clips, those without a prediction included as zeros, and total counts."""
    return samples.agg(
        F.count("*").alias("n_samples"),
        F.round(F.avg(F.col("has_prediction").cast("double")), 6).alias("strict_format_success_rate"),
        *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in MEANS),
        F.coalesce(F.sum("hallucination"), F.lit(0)).alias("total_hallucination"),
        F.coalesce(F.sum("omission"), F.lit(0)).alias("total_omission"),
    )


# Strata

#: Fixed bucket edges of the continuous axes.
EDGES = {"t60_sec": [0.3, 0.6, 0.9], "overlap_ratio": [0.1, 0.3, 0.5], "duration": [15.0, 20.0, 25.0]}
AXES = [*EDGES, "source_count", "template", "echo"]
STRATUM_MEANS = ["event_precision", "event_recall", "event_f1", "seg_f1_100ms", "onset_mae", "offset_mae", "pointer_accuracy"]


def bucket(value: Column, edges: list[float]) -> Column:
    """`<e` for the first edge above the value, else `>=` the last; null: unknown."""
    out = F.when(value.isNull(), F.lit("unknown"))
    for e in edges:
        out = out.when(value < e, F.lit(f"<{e}"))
    return out.otherwise(F.lit(f">={edges[-1]}"))


def with_buckets(samples: DataFrame, conditions: DataFrame) -> DataFrame:
    """Metrics with a bucket per axis; `conditions` has sample_id and a column per axis, echo as the delay in ms.

    A clip without conditions is in the bucket unknown, and has 0 sources.
    """
    rows = samples.join(conditions, "sample_id", "left")
    made = {f"axis_{a}": bucket(F.col(a), e) for a, e in EDGES.items()}
    made |= {f"axis_{a}": F.coalesce(F.col(a).cast("string"), F.lit("0" if a == "source_count" else "unknown")) for a in ("source_count", "template", "echo")}
    return rows.withColumns(made)


def strata(bucketed: DataFrame) -> DataFrame:
    """Per axis and bucket: clips, means and total counts; one pass, six rows per clip."""
    rows = bucketed.select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"axis_{a}").alias("bucket")) for a in AXES))).alias("s"))
    return rows.groupBy(F.col("s.axis").alias("axis"), F.col("s.bucket").alias("bucket")).agg(
        F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in STRATUM_MEANS), F.sum("hallucination").alias("hallucination"), F.sum("omission").alias("omission")
    )


def confusion(matched_any: DataFrame) -> DataFrame:
    """Counts of predicted types per reference type, from pairs (ref_type, hyp_type)."""
    return matched_any.groupBy("ref_type").pivot("hyp_type", TYPES).count().na.fill(0)
