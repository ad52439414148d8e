"""Exact substring deduplication by prefix-partitioned suffix trees.

Texts are sequences of words. A tree over every suffix would send each word with its whole
window, so the trees are sparse: suffixes start at anchors only. The anchor of a window is
its gram of `gram` words with the least hash, the first of equals, so every window has one
and all copies of a window have it at the same place. An anchor's suffix travels once, with
the words to its left that its windows reach, in a member: the run of consecutive windows
of a text that have this anchor.

Members meet by their prefix, the anchor's gram. A task sorts the suffixes of a group, and
the common prefixes of neighbours are its suffix tree: an interval of neighbours that share
t words is a node of depth t. A window that starts o words left of its anchor is a repeat
if its members share a node of depth `window` - o, and, in the tree of the reversed words
to the left, a node of depth o. Words themselves are compared; hashes only bring them together.

Groups have to fit in memory, so prefixes are of variable length. A group of more than
`limit` members is split: the windows that start near the anchor reach further to its
right, so their prefix grows to the right; the others reach further to the left, and theirs
grows to the left. Members with equal words are decided and put together before, so that a
passage that any number of texts share shrinks to one member. Halving ends when the prefix
is the window itself.

Anchors that only one distinct text has can't belong to a repeat. They are counted first,
with a few numbers each, and their members are never made.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import Ids
from .common import AT_ONCE, raw_text, released, staged
from .fim import text_index

WINDOW, LIMIT, SEED, CHUNK = 50, 8192, 42, 16_384
ROUND = 0x9E3779B97F4A7C15


def gram_of(window: int) -> int:
    """Words of an anchor: about a third of the window."""
    return max(1, round(0.32 * window))


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """The hash of each word of the texts, one after the other."""
    ids = Ids()
    numbers = np.fromiter((ids[w] for words in texts for w in words), np.int64, sum(map(len, texts)))
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in ids), np.uint64, len(ids))[numbers]


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """For each place the hash of the `gram` words that start there (of fewer at the very end)."""
    total = np.zeros(len(hashes), np.uint64)
    for j in range(gram):
        total[: len(hashes) - j] += hashes[j:] * np.uint64((2 * j + 1) * ROUND % (1 << 64))
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the least of values[i : i + width], the first of equals."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = best[step:]
        left = best[: len(best) - step]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def runs_of(texts: list[list[bytes]], window: int) -> list[tuple[int, int, int, int, int]]:
    """(text, hash, first window, its distance to the anchor, windows) of each run of windows with one anchor."""
    gram = gram_of(window)
    lengths = np.array([len(x) for x in texts], np.int64)
    if not len(texts) or lengths.max() < window:
        return []
    values = gram_hashes(word_hashes(texts), gram)
    places = least_places(values, window - gram + 1)
    begins = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = places[np.repeat(begins, windows) + start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[new, len(text)])
    text, start, anchor = text[new], start[new], anchor[new]
    top = anchor - begins[text] - start
    return list(zip(text.tolist(), values[anchor].view(np.int64).tolist(), start.tolist(), top.tolist(), count.tolist(), strict=True))


def distinct_runs(texts: list[list[bytes]], window: int) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(text, hash, distance to the anchor, windows, first windows) of the runs of each text, those of equal words together.

    A text that repeats itself, a word or a line over and over, has the same run at many places.
    """
    by: dict[tuple, list[int]] = {}
    for text, h, start, top, n in runs_of(texts, window):
        by.setdefault((text, h, top, n), []).append(start)
    for (text, h, top, n), starts in by.items():
        if len(starts) == 1:
            yield text, h, top, n, starts
            continue
        same: dict[bytes, list[int]] = {}
        for i in starts:
            same.setdefault(b" ".join(texts[text][i : i + n + window - 1]), []).append(i)
        for some in same.values():
            yield text, h, top, n, some


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of some rows at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, AT_ONCE):
            yield [c.to_pylist() for c in whole.slice(i, AT_ONCE).columns]


def anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From (key, t, raw): (h, t, n), the anchors of each text whose key the task hasn't seen, and how many distinct runs have them."""
    seen: set[bytes] = set()
    for keys, names, raws in in_slices(batches):
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        found = Counter((h, names[new[text]]) for text, h, *_ in distinct_runs([raws[i].split() for i in new], window))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())], names=["h", "t", "n"])


def member_rows(batches: Iterator[pa.RecordBatch], window: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """From (key, raw, id, marks): the members of each text whose anchors are marked."""
    for keys, raws, ids, marks in in_slices(batches):
        texts = [x.split() for x in raws]
        wanted = [set(x) for x in marks]
        runs = (x for x in distinct_runs(texts, window) if x[1] in wanted[x[0]])
        while some := list(islice(runs, CHUNK)):
            rows = [(h, 0, window - gram_of(window), ids[i], keys[i], starts, top, n, b" ".join(texts[i][starts[0] : starts[0] + n + window - 1])) for i, h, top, n, starts in some]
            yield member_batch(rows, kind)


def member_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), kind, pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=MEMBER)


MEMBER = ["g", "a", "b", "id", "key", "starts", "top", "n", "words"]


def halved(batches: Iterator[pa.RecordBatch], window: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Members with longer prefixes: the windows a to b words left of the anchor in two halves.

    All windows of a half hold the words from a left of the anchor to `window` - b right of
    it: that is the prefix which its group shares.
    """
    for columns in in_slices(batches):
        rows = []
        for g, a, b, ident, key, starts, top, n, joined in zip(*columns, strict=True):
            words, middle = joined.split(b" "), (a + b) // 2
            for low, high in ((a, middle), (middle + 1, b)):
                first, last = min(top, high), max(top - n + 1, low)  # distances of the half's windows in this member
                if low > high or first < last:
                    continue
                prefix = words[top - low : top + window - high]
                group = xxhash.xxh64_intdigest(b" ".join([str((g, low, high)).encode(), *prefix]), SEED) - (1 << 63)
                count = first - last + 1
                rows.append((group, low, high, ident, key, [x + top - first for x in starts], first, count, b" ".join(words[top - first : top - first + count + window - 1])))
        yield member_batch(rows, kind)


def tree(suffixes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of each group: order of the suffixes, and the words that each shares with the one before (-1: another group)."""
    order = np.lexsort([*suffixes.T[::-1], group])
    ranked, of = suffixes[order], group[order]
    differ = ranked[1:] != ranked[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    shared[of[1:] != of[:-1]] = -1
    return order, shared


def node_at(order: np.ndarray, shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's node of that depth, and whether other suffixes are below the node too."""
    node, inner = np.empty(len(order), np.int64), np.empty(len(order), bool)
    node[order] = np.cumsum(np.r_[0, shared < depth])
    inner[order] = np.r_[False, shared >= depth] | np.r_[shared >= depth, False]
    return node, inner


def repeats(group: list, ids: list, tops: np.ndarray, counts: np.ndarray, joined: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, distance) of each window that a smaller id has too."""
    reach, m = window - gram_of(window), len(ids)
    words = b" ".join(joined).split(b" ")
    numbers = Ids({b"": 0})
    flat = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    ends = np.cumsum(counts + window - 1)
    begins = ends - counts - window + 1
    anchor = begins + tops
    right = anchor[:, None] + np.arange(window)
    right = np.where(right < ends[:, None], flat[np.minimum(right, len(flat) - 1)], 0)
    left = anchor[:, None] - 1 - np.arange(reach)
    left = np.where(left >= begins[:, None], flat[np.maximum(left, 0)], 0)
    named = {g: i for i, g in enumerate(dict.fromkeys(group))}
    group = np.fromiter((named[g] for g in group), np.int64, m)
    rank = {x: i for i, x in enumerate(sorted({x for x in ids if x is not None}))}
    rank = np.fromiter((len(rank) if x is None else rank[x] for x in ids), np.int64, m)
    forward, backward = tree(right, group), tree(left, group)
    found = []
    for distance in range(reach + 1):
        node, inner = node_at(*forward, window - distance)
        at = np.flatnonzero(inner & (distance <= tops) & (distance > tops - counts))
        if not len(at):
            continue
        behind, _ = node_at(*backward, distance)
        classes, of = np.unique(node[at] * m + behind[at], return_inverse=True)
        least = np.full(len(classes), m)
        np.minimum.at(least, of, rank[at])
        at = at[rank[at] > least[of]]
        found.append((at, np.full(len(at), distance)))
    return tuple(np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def decide(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From members sorted by group: (key, start, stop), the words that repeated windows cover."""

    def ranges(rows: list[dict]) -> pa.RecordBatch:
        column = lambda k: np.array([r[k] for r in rows], np.int64)
        top = column("top")
        member, distance = repeats([r["g"] for r in rows], [r["id"] for r in rows], top, column("n"), [r["words"] for r in rows], window)
        found: list[tuple] = []
        order = np.lexsort([-distance, member])
        for m, some in groupby(zip(member[order].tolist(), (top[member] - distance)[order].tolist(), strict=True), key=lambda x: x[0]):
            offsets = np.array([x for _, x in some])
            begins = np.add.outer(np.array(rows[m]["starts"]), offsets).ravel()  # of repeated windows
            begins.sort()
            new = np.flatnonzero(np.r_[True, np.diff(begins) > window])
            found += zip([rows[m]["key"]] * len(new), begins[new].tolist(), (begins[np.r_[new[1:], len(begins)] - 1] + window).tolist(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["key", "start", "stop"])

    held: list[dict] = []
    rows = (x for batch in batches for i in range(0, batch.num_rows, AT_ONCE) for x in batch.slice(i, AT_ONCE).to_pylist())
    for _, members in groupby(rows, key=lambda x: x["g"]):
        held += members
        if len(held) >= CHUNK:
            yield ranges(held)
            held = []
    if held:
        yield ranges(held)


def cut_words(batches: Iterator[pa.RecordBatch], window: int, kind: pa.DataType, keep: bool) -> Iterator[pa.RecordBatch]:
    """From (id, raw, first, spans): the words that stay, per row."""
    kinds = [kind, pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep
    for columns in in_slices(batches):
        rows = []
        for ident, raw, first, spans in zip(*columns, strict=True):
            words = raw.split()
            total = len(words)
            if not first and total >= window:
                words = []
            elif spans:
                gone = np.zeros(total + 1, np.int64)
                np.add.at(gone, [x["start"] for x in spans], 1)
                np.add.at(gone, [x["stop"] for x in spans], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:total] == 0).tolist()]
            kept = b" ".join(words)
            rows.append((ident, total, total - len(words), hashlib.sha256(kept).hexdigest(), *[kept] * keep))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep])


def spans_of(docs: DataFrame, ident, text_col: str, window: int, limit: int) -> DataFrame:
    """(key, least, spans): for each distinct text its smallest id, nulls last, and the words that smaller ids have in a window too."""
    from pyspark.sql.pandas.types import to_arrow_type

    raw = raw_text(text_col)
    keyed = docs.select(F.unhex(F.sha2(raw, 256)).alias("key"), ident.alias("id"), raw.alias("raw"))
    id_type = keyed.schema["id"].dataType
    kind, schema = to_arrow_type(id_type), f"g bigint, a int, b int, id {id_type.simpleString()}, key binary, starts array<int>, top int, n int, words binary"
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    first = keyed.groupBy("key").agg(F.min(order).alias("least"))

    anchors = keyed.select("key", F.xxhash64("key").alias("t"), "raw").mapInArrow(lambda batches: anchor_rows(batches, window), "h bigint, t bigint, n bigint")
    anchors = staged(anchors.distinct())
    shared = anchors.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("members")).where("texts > 1")
    marks = anchors.join(shared, "h").groupBy("t").agg(F.collect_list(F.struct("h", "members")).alias("marks"))
    texts = staged(first.withColumn("t", F.xxhash64("key")).join(marks, "t", "left").drop("t"))

    def members(wanted) -> DataFrame:
        marked = texts.select("key", F.col("least.id").alias("id"), F.transform(F.filter("marks", wanted), lambda x: x["h"]).alias("marks")).where(F.size("marks") > 0)
        made = text_index(docs, text_col).join(marked, "key").select("key", "raw", "id", "marks")
        return made.mapInArrow(lambda batches: member_rows(batches, window, kind), schema)

    def decided(fitting: DataFrame) -> DataFrame:
        return fitting.repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: decide(batches, window), "key binary, start int, stop int")

    found = [staged(decided(members(lambda x: x["members"] <= limit)))]
    if not shared.where(F.col("members") > limit).isEmpty():
        released(docs)
        large = staged(members(lambda x: x["members"] > limit))
        while True:
            same = ["g", "top", "n", "words"]
            classes = staged(large.groupBy(*same).agg(F.min(order).alias("least")))
            ranked = large.join(classes, same)
            covered = ranked.where(order > F.col("least")).select("key", "n", F.explode("starts").alias("start"))
            found.append(staged(covered.select("key", "start", (F.col("start") + F.col("n") + window - 1).alias("stop"))))
            rest = ranked.where((order == F.col("least")) & (F.col("a") < F.col("b"))).select(*MEMBER)
            rest = staged(rest.mapInArrow(lambda batches: halved(batches, window, kind), schema))
            sizes = rest.groupBy("g").agg(F.count("*").alias("members"))
            sizes = staged(sizes.where("members > 1"))
            found.append(staged(decided(rest.join(sizes.where(F.col("members") <= limit), "g", "left_semi"))))
            large = staged(rest.join(sizes.where(F.col("members") > limit), "g", "left_semi"))
            if large.isEmpty():
                break
    spans = found[0]
    for part in found[1:]:
        spans = spans.union(part)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return staged(texts.select("key", "least").join(spans, "key", "left"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limit: int = LIMIT, keep_text: bool = False) -> DataFrame:
    """Per row of `docs`: id, n_words, n_removed, kept_sha256; with `keep_text` the kept text too (binary).

    A word goes if a window of `window` words that covers it also starts in a text with a
    smaller id. Windows are judged on the input. Equal texts are one text with the smallest
    of their ids; of the others every word goes, if a window fits in them. Null ids come
    last and count as equal, as do repeated ids: such rows take nothing from one another.
    Null text has no words; texts shorter than a window stay whole; very long texts are
    cut whole. Ids may be of any type that sorts; other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ident, kind = F.col(id_col), docs.schema[id_col].dataType
    spans = spans_of(docs, ident, text_col, window, limit)
    released(docs)
    raw = raw_text(text_col)
    rows = docs.select(ident.alias("id"), raw.alias("raw"), F.unhex(F.sha2(raw, 256)).alias("key")).join(spans, "key")
    schema = f"id {kind.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * keep_text
    arrow = to_arrow_type(kind)
    cut = rows.select("id", "raw", F.col("id").eqNullSafe(F.col("least.id")).alias("first"), "spans").mapInArrow(lambda batches: cut_words(batches, window, arrow, keep_text), schema)
    return cut.withColumnRenamed("id", id_col)
