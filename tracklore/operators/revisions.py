"""Checks of rewritten ledgers, and edits of ledgers as a log that can be applied and taken back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv

#: Fields of events that a rewrite may not change; the text and the confidence are free.
LOCKED = ("type", "track_id", "verbatim", "spans")
EVENT = f"struct<type:string,track_id:string,text:string,confidence_mils:int,spans:{iv.SPANS}>"


def field_text(column: str, kind: str) -> Column:
    """A field as text; spans as `start-end` in order."""
    if kind.startswith("array"):
        return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws("-", s["start_ds"].cast("string"), s["end_ds"].cast("string"))), " ")
    return F.col(column).cast("string")


def locked_changes(before: DataFrame, after: DataFrame, locked: tuple[str, ...] = LOCKED) -> DataFrame:
    """(sample_id, event_id, path, before, after, rule) of what a rewrite changed though it may not.

    Both sides have events, a row each: sample_id, event_id and the locked fields. An event
    may neither come (`new_event`) nor go (`lost_event`), nor stand twice (`repeated_event`);
    its locked fields stay (`changed_field`, null equals null). Both sides meet once, by event.
    """
    kinds = dict(before.dtypes)

    def side(df: DataFrame, which: str) -> DataFrame:
        values = F.array(*(field_text(c, kinds[c]) for c in locked))
        return df.select("sample_id", "event_id", F.lit(which).alias("side"), values.alias("values"))

    of = lambda which: F.col("side") == which
    met = side(before, "before").unionByName(side(after, "after")).groupBy("sample_id", "event_id").agg(
        *(F.min(F.when(of(x), F.col("values"))).alias(x) for x in ("before", "after")), *(F.count_if(of(x)).alias(f"n_{x}") for x in ("before", "after")),
    )
    whole = F.when(F.col("n_before") == 0, "new_event").when(F.col("n_after") == 0, "lost_event").when(F.col("n_after") > F.col("n_before"), "repeated_event")
    change = lambda i, name: F.struct(F.lit(f"events.{name}").alias("path"), F.get("before", F.lit(i)).alias("before"), F.get("after", F.lit(i)).alias("after"), F.lit("changed_field").alias("rule"))
    nothing = F.lit(None).cast("string")
    fields = F.filter(F.array(*(change(i, c) for i, c in enumerate(locked))), lambda x: ~x["before"].eqNullSafe(x["after"]))
    found = F.when(whole.isNotNull(), F.array(F.struct(F.lit("events").alias("path"), nothing.alias("before"), nothing.alias("after"), whole.alias("rule")))).otherwise(fields)
    return met.select("sample_id", "event_id", F.inline(found))


# Edits

def gated(log: DataFrame, hidden: float, audible: float) -> DataFrame:
    """`log` with `target`: what an added event is worth by its `audibility`.

    Below `hidden` it must not be added, above `audible` it must; between them, or without
    an audibility, it is ignored. Other edits must be made.
    """
    a = F.col("audibility")
    target = F.when(F.col("op") != "ADD", "must_edit").when(a < hidden, "must_not_add").when(a > audible, "must_add").otherwise("ignore")
    return log.withColumn("target", target)


def effective(log: DataFrame) -> DataFrame:
    """The edits of a `gated` log that change the ledger."""
    return log.where(F.col("target").isin("must_edit", "must_add"))


def inverted(log: DataFrame) -> DataFrame:
    """The log that takes `log` back: the last edit first, additions removed, shifts and losses of confidence the other way."""
    op = F.when(F.col("op") == "ADD", "REMOVE").when(F.col("op") == "REMOVE", "ADD").otherwise(F.col("op"))
    return log.withColumns({"op": op, "seq": -F.col("seq"), "by": -F.col("by")})


def edited(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events (sample_id, event_id, type, track_id, text, confidence_mils, spans) after the edits of `log`.

    `log` has sample_id, event_id, seq, op, by and event: ADD and REMOVE carry the whole
    event, so that both can be taken back; SHIFT moves all spans by `by` tenths; DEGRADE
    lowers the confidence by `by` thousandths. Edits of one event follow each other by seq.
    Events and edits meet once, by event. What can't be done fails the job with its reason:
    adding an event that is there, changing or removing one that isn't.
    """
    fields = ("type", "track_id", "text", "confidence_mils", "spans")
    own = events.select("sample_id", "event_id", F.struct(F.lit(None).cast("bigint").alias("seq"), F.lit("BASE").alias("op"), F.lit(0).cast("int").alias("by"), F.struct(*fields).cast(EVENT).alias("event")).alias("edit"))
    more = log.select("sample_id", "event_id", F.struct(F.col("seq").cast("bigint").alias("seq"), "op", F.col("by").cast("int").alias("by"), F.col("event").cast(EVENT).alias("event")).alias("edit"))
    met = own.unionByName(more).groupBy("sample_id", "event_id").agg(F.array_sort(F.collect_list("edit")).alias("edits"))  # null, the event itself, sorts first
    nothing = F.lit(None).cast(EVENT)
    fail = lambda why: F.raise_error(F.concat(F.lit(why + " "), "sample_id", F.lit(" "), "event_id")).cast(EVENT)

    def step(now: Column, e: Column) -> Column:
        shifted = now.withField("spans", F.transform(now["spans"], lambda s: iv.span(s["start_ds"] + e["by"], s["end_ds"] + e["by"])))
        weaker = now.withField("confidence_mils", now["confidence_mils"] - e["by"])
        there = F.when(e["op"].isin("BASE", "ADD"), F.when(now.isNull(), e["event"]).otherwise(fail("added twice:")))
        return there.otherwise(F.when(now.isNull(), fail("edited but absent:")).when(e["op"] == "REMOVE", nothing).when(e["op"] == "SHIFT", shifted).when(e["op"] == "DEGRADE", weaker).otherwise(fail("unknown edit:")))

    return met.withColumn("now", F.aggregate("edits", nothing, step)).where("now IS NOT NULL").select("sample_id", "event_id", "now.*")


# Evidence

def supported_spans(spans: DataFrame, least: int = 2, by: tuple[str, ...] = ("sample_id", "type"), voters: tuple[str, ...] | None = None) -> DataFrame:
    """(by, start_ds, end_ds, support) of the times that `least` teachers or more mark, from (by, teacher, spans).

    A sweep over the ends of each teacher's united spans: running sums give the number of
    teachers between two ends; neighbouring times with enough are one span, whose support
    is the most teachers at once. Only `voters` count towards `least`, if they are named;
    all count as support.
    """
    united = spans.groupBy(*by, "teacher").agg(iv.merged(F.flatten(F.collect_list("spans"))).alias("spans"))
    vote = F.lit(1) if voters is None else F.col("teacher").isin(*voters).cast("int")
    ends = united.select(*by, vote.alias("vote"), F.explode("spans").alias("s"))
    ends = ends.select(*by, "vote", F.explode(F.array(F.struct(F.col("s.start_ds").alias("at"), F.lit(1).alias("way")), F.struct(F.col("s.end_ds").alias("at"), F.lit(-1).alias("way")))).alias("e"))
    steps = ends.groupBy(*by, F.col("e.at").alias("at")).agg(F.sum(F.col("e.way") * F.col("vote")).alias("votes"), F.sum("e.way").alias("all_"))
    order = Window.partitionBy(*by).orderBy("at")
    now = steps.select(*by, "at", F.lead("at").over(order).alias("until"), F.sum("votes").over(order).alias("votes"), F.sum("all_").over(order).alias("support")).where(F.col("votes") >= least)
    new = F.coalesce((F.lag("until").over(order) < F.col("at")).cast("int"), F.lit(1))
    numbered = now.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return numbered.groupBy(*by, "run").agg(F.min("at").alias("start_ds"), F.max("until").alias("end_ds"), F.max("support").alias("support")).drop("run")
