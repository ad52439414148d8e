"""Event slots: fixed numbers of predicted events per clip, as arrays.

A slot has an eventness, probabilities of the types in the order of `TYPES`, and either a
mask over tenths of a second or an onset and an offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from . import match
from .ledger import TYPES

EVENTNESS, ACTIVE, NEAR_ZERO = 0.4, 0.5, 1e-6


def best_type(probabilities: Column) -> Column:
    """The type of the highest probability, the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, TYPES)), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def mask_bounds(mask: Column) -> Column:
    """The span from the first set flag to the one after the last; null if none is set."""
    first = F.array_position(mask, True)
    last = F.size(mask) + 1 - F.array_position(F.reverse(mask), True)
    return F.when(first > 0, iv.span(first - 1, last))


def slot_events(slots: DataFrame, threshold: float = EVENTNESS) -> DataFrame:
    """Events of `slots(sample_id, slot, eventness, type_probs, activity | onset_ds, offset_ds)`: event_id, type, spans, text, confidence.

    A slot counts from `threshold` on, if its mask has a frame above `ACTIVE`, or its offset
    comes after its onset. Ids number the events of a clip in order of their slots.
    """
    bounds = mask_bounds(F.transform("activity", lambda x: x > ACTIVE)) if "activity" in slots.columns else F.when(F.col("offset_ds") > F.col("onset_ds"), iv.span(F.col("onset_ds"), F.col("offset_ds")))
    kept = slots.where(F.col("eventness") >= threshold).withColumn("span", bounds).where(F.col("span").isNotNull())
    event = F.struct("slot", best_type(F.col("type_probs")).alias("type"), "span", F.round("eventness", 3).alias("confidence"))
    clips = kept.groupBy("sample_id").agg(F.array_sort(F.collect_list(event)).alias("all_")).select("sample_id", F.posexplode("all_").alias("ord", "e"))
    return clips.select("sample_id", F.format_string("E%03d", F.col("ord") + 1).alias("event_id"), "ord", F.col("e.slot").alias("slot"), F.col("e.type").alias("type"), F.lit(None).cast("string").alias("track_id"), F.array("e.span").alias("spans"), F.col("e.type").alias("text"), F.col("e.confidence").alias("confidence"))


def slot_targets(events: Column, frames: int, most: int) -> Column:
    """The first `most` events as targets: array<struct<type_index, onset, offset, valid>>, filled up to `most`.

    Frames are cut to the clip and there is one at least; an unknown type counts as the first.
    """
    clamped = lambda x: F.greatest(F.lit(0), F.least(F.lit(frames), x))

    def target(e: Column) -> Column:
        onset = clamped(iv.onset(e["spans"]))
        index = F.greatest(F.array_position(F.array(*map(F.lit, TYPES)), e["type"]) - 1, F.lit(0)).cast("int")
        return F.struct(index.alias("type_index"), onset.alias("onset"), F.greatest(onset + 1, clamped(iv.offset(e["spans"]))).alias("offset"), F.lit(True).alias("valid"))

    empty = F.struct(F.lit(0).alias("type_index"), F.lit(0).alias("onset"), F.lit(0).alias("offset"), F.lit(False).alias("valid"))
    return F.slice(F.concat(F.transform(F.slice(events, 1, most), target), F.array_repeat(empty, most)), 1, most)


def target_mask(target: Column, frames: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: (i >= target["onset"]) & (i < target["offset"]))


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks, with a term that keeps empty ones at 0."""
    count = lambda both: F.aggregate(F.zip_with(a, b, both), F.lit(0), lambda n, x: n + x.cast("int"))
    return count(lambda x, y: x & y) / (count(lambda x, y: x | y) + NEAR_ZERO)


def slot_costs(slots: DataFrame, targets: DataFrame, frames: int) -> DataFrame:
    """(sample_id, slot, target, cost) of every slot and valid target of a clip.

    The missing probability of the target's type and, with masks, the missing IoU; else
    the mean distance of the boundaries in parts of the target's length. Clips have a fixed
    small number of slots and targets.
    """
    pairs = slots.join(targets.where("target.valid").select("sample_id", F.col("pos").alias("target"), F.col("target").alias("t")), "sample_id")
    kind = 1 - F.element_at("type_probs", F.col("t.type_index") + 1)
    if "activity" in slots.columns:
        place = 1 - mask_iou(F.transform("activity", lambda x: x > ACTIVE), target_mask(F.col("t"), frames))
    else:
        place = (F.abs(F.col("onset_ds") - F.col("t.onset")) + F.abs(F.col("offset_ds") - F.col("t.offset"))) / (2 * F.greatest(F.lit(1), F.col("t.offset") - F.col("t.onset")))
    return pairs.select("sample_id", "slot", "target", (kind + place).alias("cost"))


def slot_assignment(costs: DataFrame) -> DataFrame:
    """The pairs of `slot_costs` that are assigned: as many as slots or targets allow, at the least total cost."""
    ids = {"ref_event_id": F.col("target").cast("string"), "hyp_event_id": F.col("slot").cast("string"), "type": F.lit("")}
    units = match.units(F.col("cost"), "sample_id", "ref_event_id", "hyp_event_id")
    marked = costs.repartition("sample_id").withColumns(ids).withColumns({"units": units}).sortWithinPartitions("sample_id")
    return marked.mapInArrow(match.solve, marked.schema).select(*costs.columns)
