"""Constraint checks on ledgers: one row per violation instead of an exception.

Inputs are the flat frames of `ledger`: clips(sample_id, duration_ds), tracks, events,
relations; spans may be any. Each check is a filter, an anti-join or a count, so a
violation never fails the job and its clip can be removed with an anti-join. What is
joined or counted by clip is dealt to tasks of bounded size; `rows` is the number of rows
that sets their number, events are counted by default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from .ledger import KINDS, PREDICATES, TYPES
from .staging import dealt


def found(df: DataFrame, rule: str, owner: str | None) -> DataFrame:
    return df.select("sample_id", F.lit(rule).alias("rule"), (F.col(owner) if owner else F.lit(None)).cast("string").alias("owner_id"))


def bad_span(s: Column) -> Column:
    return s["start_ds"].isNull() | s["end_ds"].isNull() | (s["start_ds"] < 0) | (s["end_ds"] <= s["start_ds"])


def dangling_tracks(events: DataFrame, tracks: DataFrame, rows: int | None = None) -> DataFrame:
    """Events whose track doesn't exist in their clip; events without a track are right."""
    rows, keys = events.count() if rows is None else rows, ["sample_id", "track_id"]
    return dealt(events.where("track_id is not null"), *keys, rows=rows).join(dealt(tracks.select(*keys), *keys, rows=rows).distinct(), keys, "left_anti")


def dangling_relations(relations: DataFrame, events: DataFrame, rows: int | None = None) -> DataFrame:
    rows, keys = events.count() if rows is None else rows, ["sample_id", "target_event_id"]
    known = dealt(events.select("sample_id", F.col("event_id").alias("target_event_id")), *keys, rows=rows).distinct()
    return dealt(relations, *keys, rows=rows).join(known, keys, "left_anti")


def repeated_ids(df: DataFrame, ident: str, rows: int | None = None) -> DataFrame:
    return dealt(df.select("sample_id", ident), "sample_id", ident, rows=rows).groupBy("sample_id", ident).agg(F.count("*").alias("n")).where("n > 1")


def with_ends(df: DataFrame, clips: DataFrame, how: str, rows: int | None = None) -> DataFrame:
    """`df` with `late`: whether a row's `end_` is after its clip."""
    rows = df.count() if rows is None else rows
    ends = dealt(clips.select("sample_id", "duration_ds"), "sample_id", rows=rows)
    return dealt(df, "sample_id", rows=rows).join(ends, "sample_id", how).withColumn("late", F.coalesce(F.col("end_") > F.col("duration_ds"), F.lit(False))).drop("end_", "duration_ds")


def outside_clip(df: DataFrame, clips: DataFrame) -> DataFrame:
    """Rows with a span that ends after their clip."""
    named = df.withColumn("end_", iv.offset(F.col("spans")))
    return with_ends(named, clips, "inner").where("late").drop("late")


def broken_rules(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks by itself."""
    return F.filter(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules.items())), lambda r: r.isNotNull())


def own_rules(df: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """(sample_id, rule, owner_id): the rules that each row breaks by itself, in one pass."""
    return df.select("sample_id", F.explode(broken_rules(rules)).alias("rule"), F.col(ident).cast("string").alias("owner_id"))


def rules_and_ends(df: DataFrame, ident: str, what: str, rules: dict[str, Column], clips: DataFrame, rows: int) -> DataFrame:
    """`own_rules`, and which rows end after their clip; of a row only its id, its end and the broken rules move."""
    small = df.select("sample_id", F.col(ident).cast("string").alias("owner_id"), broken_rules(rules).alias("rules"), iv.offset(F.col("spans")).alias("end_"))
    outside = F.when(F.col("late"), F.array(F.lit(f"{what}_outside"))).otherwise(F.array().cast("array<string>"))
    return with_ends(small, clips, "left", rows).select("sample_id", F.explode(F.concat("rules", outside)).alias("rule"), "owner_id")


def violations(clips: DataFrame, tracks: DataFrame, events: DataFrame, relations: DataFrame) -> DataFrame:
    """(sample_id, rule, owner_id) of every violated constraint.

    What a row breaks by itself is found in one pass per table; repeated ids and missing
    targets take a count and an anti-join each. Tables of tracks and relations are taken
    to be no larger than that of events.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    spans, rows = F.col("spans"), events.count()
    shared = lambda what: {f"{what}_span": F.exists(spans, bad_span), f"{what}_overlap": ~iv.disjoint(spans), f"{what}_confidence": no(F.col("confidence").between(0, 1))}
    parts = [
        own_rules(clips.withColumn("none_", F.lit(None).cast("string")), "none_", {"duration": no(F.col("duration_ds") > 0)}),
        rules_and_ends(events, "event_id", "event", shared("event") | {"event_without_span": F.size(spans) < 1, "event_id": no(F.col("event_id").rlike("^E[0-9]+$")), "event_type": no(F.col("type").isin(TYPES)), "event_text": F.coalesce(F.length("text"), F.lit(0)) < 1}, clips, rows),
        rules_and_ends(tracks, "track_id", "track", shared("track") | {"track_id": no(F.col("track_id").rlike("^T[0-9]+$")), "track_kind": no(F.col("kind").isin(KINDS))}, clips, rows),
        own_rules(relations, "event_id", {"relation_predicate": no(F.col("predicate").isin(PREDICATES))}),
        found(repeated_ids(events, "event_id", rows), "event_repeated", "event_id"),
        found(repeated_ids(tracks, "track_id", rows), "track_repeated", "track_id"),
        found(dangling_tracks(events, tracks, rows), "event_track", "event_id"),
        found(dangling_relations(relations, events, rows), "relation_target", "event_id"),
    ]
    return reduce(DataFrame.unionAll, parts)


def unknown_fields(raw: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(sample_id, rule, owner_id): keys of the JSON in `raw(sample_id, json)` that a level doesn't allow.

    `allowed` maps a JSON path to its keys, `$` being the top.
    """
    parts = []
    for path, keys in allowed.items():
        level = F.col("json") if path == "$" else F.get_json_object("json", path)
        extra = F.array_except(F.json_object_keys(level), F.array(*map(F.lit, keys)))
        parts.append(raw.select("sample_id", F.lit("unknown_field").alias("rule"), F.explode(extra).alias("owner_id")))
    return reduce(DataFrame.unionAll, parts)


def summary(found_: DataFrame) -> DataFrame:
    """Per rule the number of violations and of clips."""
    return found_.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_clips"))
