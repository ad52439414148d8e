"""Interval algebra on span arrays: array<struct<start_ds:int,end_ds:int>>, in tenths of a second.

Everything is a Column expression, so it stays in the row and needs no shuffle. Empty and
null arrays count as no spans.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start_ds:int,end_ds:int>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row; without it a lambda recomputes it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(made):
    """Decorator of a Column function: its first argument is computed once a row."""

    @wraps(made)
    def outer(first: Column, *rest, **named) -> Column:
        return let(first, lambda x: made(x, *rest, **named))

    return outer


def none() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start_ds"), end.cast("int").alias("end_ds"))


def grid(seconds: Column) -> Column:
    """Seconds to tenths, halves to even, as an int."""
    return F.rint(seconds / 0.1).cast("int")


def seconds(tenths: Column) -> Column:
    return F.round(tenths / 10.0, 6)


def merged(spans: Column, gap: int = 0) -> Column:
    """Sorted spans with those joined that overlap, or that are less than `gap` apart.

    With gap 0 spans that only touch stay apart. Starts and ends are sorted by themselves:
    where the start after the i-th is `gap` beyond the i-th end, exactly the first i spans
    are over, so a joined span ends there. That takes no running state and no copy.
    """

    def joined(all_: Column) -> Column:
        return let(starts_of(all_), lambda s: let(ends_of(all_), lambda e: let(last_places(s, e), lambda at: F.transform(at, lambda i, k: span(F.get(s, F.coalesce(F.get(at, k - 1) + 1, F.lit(0))), F.get(e, i))))))

    def last_places(s: Column, e: Column) -> Column:
        return F.filter(places(F.size(s)), lambda i: F.coalesce(F.get(s, i + 1) - F.get(e, i) >= gap, F.lit(True)))

    def one(all_: Column) -> Column:
        return F.when(F.size(all_) < 2, all_).when(F.exists(all_, lambda x: x["start_ds"] >= x["end_ds"]), folded(all_, gap)).otherwise(joined(all_))

    return let(F.coalesce(spans, none()), one)


def folded(spans: Column, gap: int) -> Column:
    """`merged` of spans of which some have no length: one after the other, as starts and ends alone don't tell."""

    def step(done: Column, new: Column) -> Column:
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (new["start_ds"] - last["end_ds"] >= gap)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(last["start_ds"], F.greatest(last["end_ds"], new["end_ds"]))))
        return F.when(apart, F.concat(done, F.array(new))).otherwise(longer)

    return F.aggregate(F.array_sort(spans), none(), step)


def starts_of(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda x: x["start_ds"]))


def ends_of(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda x: x["end_ds"]))


def places(n: Column) -> Column:
    """0, 1, .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def covered(spans: Column, times: int) -> Column:
    """Tenths that `times` of the spans or more cover at once.

    Between the i-th end and the next, in order, i spans are over; so `times` are open from
    the start on that is `times` further.
    """
    part = lambda s, e, i: F.get(e, i) - F.greatest(F.coalesce(F.get(e, i - 1), F.get(s, F.lit(0))), F.get(s, i + times - 1))
    total = lambda s, e: F.aggregate(places(F.size(s) - (times - 1)), F.lit(0), lambda n, i: n + F.greatest(F.lit(0), part(s, e, i)))
    return let(F.coalesce(spans, none()), lambda all_: let(starts_of(all_), lambda s: let(ends_of(all_), lambda e: total(s, e))))


def length(spans: Column) -> Column:
    """Sum of the spans' lengths; overlaps count each time."""
    return F.aggregate(F.coalesce(spans, none()), F.lit(0), lambda n, s: n + s["end_ds"] - s["start_ds"])


def common(a: Column, b: Column) -> Column:
    """Length of the intersection of two sets of disjoint spans, which is what is covered twice."""
    shared = lambda s, t: F.greatest(F.lit(0), F.least(s["end_ds"], t["end_ds"]) - F.greatest(s["start_ds"], t["start_ds"]))
    both = lambda x, y: F.when((F.size(x) == 1) & (F.size(y) == 1), shared(F.get(x, F.lit(0)), F.get(y, F.lit(0)))).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0)).otherwise(covered(F.concat(x, y), 2))
    return let(F.coalesce(a, none()), lambda x: let(F.coalesce(b, none()), lambda y: both(x, y)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two sets of disjoint spans, to six places; 0 where the union is empty."""
    union = length(a) + length(b) - common(a, b)
    return F.when(union <= 0, F.lit(0.0)).otherwise(F.round(common(a, b) / union, 6))


def onset(spans: Column) -> Column:
    return F.array_min(F.transform(spans, lambda s: s["start_ds"]))


def offset(spans: Column) -> Column:
    return F.array_max(F.transform(spans, lambda s: s["end_ds"]))


def disjoint(spans: Column) -> Column:
    """Whether no two spans overlap; touching is allowed."""
    clash = lambda o: F.size(F.filter(F.sequence(F.lit(1), F.size(o)), lambda i: F.get(o, i)["start_ds"] < F.get(o, i - 1)["end_ds"]))
    return let(F.array_sort(F.coalesce(spans, none())), clash) == 0


def runs(mask: Column) -> Column:
    """Spans of the runs of true in an array of flags: first position and the one after the last."""

    def found(m: Column) -> Column:
        edge = lambda by: F.filter(places(F.size(m)), lambda i: F.get(m, i) & ~F.coalesce(F.get(m, i + by), F.lit(False)))
        return F.zip_with(edge(-1), edge(1), lambda first, last: span(first, last + 1))

    return let(mask, found)


def overlap_ratio(spans_by_source: Column, duration: Column) -> Column:
    """Share of a clip's tenths in which two sources or more are active: array of span arrays."""
    each = F.flatten(F.transform(spans_by_source, lambda spans: F.filter(merged(spans), lambda s: s["end_ds"] > s["start_ds"])))
    return F.when(duration > 0, F.round(covered(each, 2) / duration, 6)).otherwise(F.lit(0.0))
