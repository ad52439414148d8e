"""Caption text: token overlap, trimming, time tokens, formatters and the atomic parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import intervals as iv

#: Fixed values of the caption formats.
TYPES = ["speech", "lys", "music", "sfx"]
STYLE_WORDS = {"keyword": 4, "brief": 12, "detailed": 60}
LAST_TOKEN = 300
EMPTY, EMPTY_SLOTS, UNDESCRIBED = "<empty/>", "<n>0</n><empty/>", "undescribed event"
PARSED_CONFIDENCE = 0.9


def words(text: Column) -> Column:
    """Words between runs of Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of lower-case words, to six places; two empty texts: 1, one: 0."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    both = F.size(F.array_intersect(x, y))
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0))
        .when((F.size(x) == 0) | (F.size(y) == 0) | (both == 0), F.lit(0.0))
        .otherwise(F.round(2.0 * both / (F.size(x) + F.size(y)), 6))
    )


def styled(text: Column, style: str = "brief") -> Column:
    """At most the style's number of words, then an ellipsis; shorter text as it is."""
    most, w = STYLE_WORDS.get(style, STYLE_WORDS["detailed"]), words(text)
    return F.when(F.size(w) <= most, text).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("…")))


def time_token(tenths: Column) -> Column:
    return F.format_string("<|t_%03d|>", F.greatest(F.lit(0), F.least(F.lit(LAST_TOKEN), tenths)).cast("int"))


def token_time(token: Column) -> Column:
    """Tenths of a whole time token; null for any other text."""
    found = F.regexp_extract(F.trim(token), r"^<\|t_(\d{3})\|>$", 1)
    return F.when(found != "", found.cast("int"))


def short_number(tenths: Column) -> Column:
    """Tenths as seconds without a needless fraction: 5 -> 0.5, 30 -> 3."""
    whole, rest = F.floor(tenths / 10).cast("string"), F.pmod(tenths, F.lit(10))
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), rest.cast("string")))


def short_double(x: Column) -> Column:
    """A number of up to six significant digits without trailing zeros, for values from 0.0001 to 999999."""
    text = F.format_string("%.6f", F.round(x, 6))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(short_number(s["start_ds"]), F.lit("-"), short_number(s["end_ds"]))), ",")


def parsed_spans(text: Column) -> Column:
    """Spans of a comma list `start-end`; null where a piece isn't one."""
    pieces = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    start = lambda p: F.substring_index(p, "-", 1).try_cast("double")
    end = lambda p: F.regexp_extract(p, r"^[^-]*-(.*)$", 1).try_cast("double")
    made = F.transform(pieces, lambda p: iv.span(iv.grid(start(p)), iv.grid(end(p))))
    return F.when(F.forall(made, lambda s: s["start_ds"].isNotNull() & s["end_ds"].isNotNull()), made)


def ordered(events: Column) -> Column:
    """Events by onset, then speech, lys, music, sfx, others, then id as text."""
    rank = lambda e: F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), e["type"]), F.lit(0))
    keyed = F.transform(events, lambda e: F.struct(iv.onset(e["spans"]).alias("on"), F.when(rank(e) == 0, 9).otherwise(rank(e)).alias("rank"), e["id"].alias("id"), e.alias("event")))
    by = lambda a, b: F.when(a < b, -1).when(a > b, 1)
    keys = lambda k: F.struct(k["on"], k["rank"], k["id"])
    return F.transform(F.array_sort(keyed, lambda a, b: by(keys(a), keys(b)).otherwise(0)), lambda k: k["event"])


def tokens_of(event: Column, style: str) -> Column:
    """One event as a tag around time tokens; the text follows the first of them."""
    spans = F.transform(event["spans"], lambda s, i: F.concat(time_token(s["start_ds"]), F.when(i == 0, styled(event["text"], style)).otherwise(""), time_token(s["end_ds"])))
    return F.concat(F.lit("<"), event["type"], F.lit(">"), F.array_join(spans, ""), F.lit("</"), event["type"], F.lit(">"))


def atomic_caption(events: Column, style: str = "brief") -> Column:
    return F.when(F.size(events) == 0, F.lit(EMPTY)).otherwise(F.array_join(F.transform(ordered(events), lambda e: tokens_of(e, style)), ""))


def slot_caption(events: Column, style: str = "brief") -> Column:
    slots = F.transform(ordered(events), lambda e: F.concat(F.lit("<slot>"), tokens_of(e, style), F.lit("</slot>")))
    return F.when(F.size(events) == 0, F.lit(EMPTY_SLOTS)).otherwise(F.concat(F.lit("<n>"), F.size(events).cast("string"), F.lit("</n>"), F.array_join(slots, "")))


def xml_caption(events: Column, style: str = "brief") -> Column:
    """One tag a line with times, confidence and track; texts aren't escaped."""

    def line(e: Column) -> Column:
        track = F.when(e["track_id"].isNotNull(), F.concat(F.lit(' track="'), e["track_id"], F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), e["type"], F.lit(' t="'), span_list(e["spans"]), F.lit('" confidence="'), short_double(e["confidence"]), F.lit('"'), track, F.lit(">"), styled(e["text"], style), F.lit("</"), e["type"], F.lit(">"))

    return F.when(F.size(events) == 0, F.lit(EMPTY)).otherwise(F.array_join(F.transform(ordered(events), line), "\n"))


def parsed_atomic(text: Column) -> Column:
    """Events found in an atomic caption: array<struct<type,spans,text>>.

    A tag runs to the next closing tag of any type. Its tokens pair up as spans; an odd
    last one and spans that don't end after their start are ignored, as are tags without
    a span.
    """
    tag = r"(?s)<(speech|lys|music|sfx)>.*?</(?:speech|lys|music|sfx)>"

    def event(found: Column) -> Column:
        kind = F.regexp_extract(found, r"^<(\w+)>", 1)
        body = F.regexp_replace(F.regexp_replace(found, r"^<\w+>", ""), r"</\w+>$", "")
        times = F.transform(F.regexp_extract_all(body, F.lit(r"<\|t_(\d{3})\|>"), 1), lambda x: x.cast("int"))
        pairs = F.transform(F.when(F.size(times) >= 2, F.sequence(F.lit(0), F.floor(F.size(times) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: iv.span(F.get(times, 2 * i), F.get(times, 2 * i + 1)))
        bare = F.regexp_replace(F.regexp_replace(body, r"<\|t_\d{3}\|>", ""), r"(?U)^\s+|\s+$", "")
        return F.struct(kind.alias("type"), F.filter(pairs, lambda s: s["end_ds"] > s["start_ds"]).alias("spans"), bare.alias("text"))

    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(tag), 0)
    return F.filter(F.transform(found, event), lambda e: F.size(e["spans"]) > 0)


def ledger_events(parsed: Column) -> Column:
    """Parsed events with ids E001.. and a track per type, T1.. by first appearance."""
    kinds = F.array_distinct(F.transform(parsed, lambda e: e["type"]))
    return F.transform(
        parsed,
        lambda e, i: F.struct(
            F.format_string("E%03d", i + 1).alias("id"),
            e["type"].alias("type"),
            F.concat(F.lit("T"), F.array_position(kinds, e["type"]).cast("string")).alias("track_id"),
            e["spans"].alias("spans"),
            F.when(e["text"] == "", F.lit(UNDESCRIBED)).otherwise(e["text"]).alias("text"),
            F.lit(PARSED_CONFIDENCE).alias("confidence"),
        ),
    )


def ledger_tracks(parsed: Column) -> Column:
    """The tracks that `ledger_events` refers to; each has the spans of its type's first event."""
    kinds = F.array_distinct(F.transform(parsed, lambda e: e["type"]))
    return F.transform(
        kinds,
        lambda k, i: F.struct(
            F.concat(F.lit("T"), (i + 1).cast("string")).alias("id"),
            F.when(k == "lys", F.lit("vocal")).otherwise(k).alias("kind"),
            F.get(F.filter(parsed, lambda e: e["type"] == k), F.lit(0))["spans"].alias("spans"),
            F.lit(PARSED_CONFIDENCE).alias("confidence"),
        ),
    )


def review_text(events: Column) -> Column:
    """`type [start-end] text` per event, texts of 30 characters, joined by ` | `."""
    tenth = lambda d: F.format_string("%.1f", d / 10.0)
    return F.array_join(F.transform(events, lambda e: F.concat(e["type"], F.lit(" ["), tenth(iv.onset(e["spans"])), F.lit("-"), tenth(iv.offset(e["spans"])), F.lit("] "), F.substring(e["text"], 1, 30))), " | ")
