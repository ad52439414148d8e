"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint is 64 bits over the XXH64 values of a text's word shingles. Fingerprints
that differ in at most `max_diff` bits are linked; linked texts form groups.

Search: the 64 bits form a ring of `SEGMENTS` segments. If two fingerprints differ in at
most t bits, there is a start segment from which every chain of l consecutive segments
holds at most l*t/SEGMENTS differences (the pigeonring principle). The longest chain whose
budget is below one must agree exactly, so it is the join key; the longer chains are then
checked in turn, the last of them being the full Hamming distance.

A key shared by more than `BUCKET` fingerprints isn't joined with itself. Its members
differ only outside the key, so each lists itself with every single bit outside the key
flipped; two fingerprints within two bits share an entry, and those that share an entry
are within two bits. An entry has no more members than it has bits, which bounds the work
by the number of fingerprints whatever the bucket's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT_ONCE, given_back, per_row, raw_text, released, sized, staged
from .graph import connected_components

BITS, SEGMENTS, BUCKET, SEED = 64, 7, 32, 42


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit integer, signed, of the bits set in over half of the uint64 `hashes`."""
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def shingles(raw: bytes, width: int) -> list[bytes]:
    """Word shingles of UTF-8 text, A-Z in lower case, repeats kept; all words if they are fewer."""
    words = raw.lower().split()  # bytes: lower() and split() know ASCII only
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprinter(width: int):
    def each(raw: bytes) -> tuple[int]:
        parts = shingles(raw, width)
        if not parts:
            return (0,)
        return (bit_majority(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts))),)

    return each


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer; no word or null text: 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    return per_row(docs, lambda: fingerprinter(width), [id_col], text_col, f"`{id_col}` {kind}, fp bigint")


def ring(max_diff: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Start bit of each segment, bits in the chains of length 1.. from each, budget of each length."""
    cuts = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
    width = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    chains = [[sum(width[(i + j) % SEGMENTS] for j in range(n)) for n in range(1, SEGMENTS + 1)] for i in range(SEGMENTS)]
    return cuts[:-1], chains, [n * max_diff // SEGMENTS for n in range(1, SEGMENTS + 1)]


def low_bits(n: int) -> int:
    return -1 if n >= BITS else (1 << n) - 1


def links(prints: DataFrame, max_diff: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): links that join all of `prints(fp)` (distinct values) within `max_diff` bits.

    With `by`, values are linked only where these columns agree, and the columns come first.

    Every such pair is either a row or joined by a path of rows through its shared entry.
    `max_diff` is 0, 1 or 2; the path for large buckets rests on that.
    """
    if not 0 <= max_diff <= 2:
        raise ValueError("max_diff must be 0, 1 or 2")
    starts, chains, budget = ring(max_diff)
    exact = sum(1 for x in budget if x == 0)
    turned = lambda x, i: x if not starts[i] else F.shiftrightunsigned(x, starts[i]).bitwiseOR(F.shiftleft(x, BITS - starts[i]))
    if exact == SEGMENTS:
        return prints.select(*by, F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    fp, on = F.col("fp"), [*by, "i", "key"]
    keys = prints.select(*by, "fp", F.posexplode(F.array(*(turned(fp, i).bitwiseAND(F.lit(low_bits(chains[i][exact - 1]))) for i in range(SEGMENTS)))).alias("i", "key"))
    shared = keys.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    keys = staged(keys.join(shared, on))

    few = keys.where(F.col("n") <= BUCKET).drop("n")
    pairs = few.select(*on, F.col("fp").alias("a")).join(few.select(*on, F.col("fp").alias("b")), on).where("a < b")
    viable = F.lit(False)
    for i in range(SEGMENTS):
        x = turned(F.col("a").bitwiseXOR(F.col("b")), i)
        kept = F.col("i") == i
        for n in range(exact, SEGMENTS):
            kept = kept & (F.bit_count(x.bitwiseAND(F.lit(low_bits(chains[i][n])))) <= budget[n])
        viable = viable | kept
    pairs = pairs.where(viable).select(*by, "a", "b")

    held = F.element_at(F.array(*(F.lit(starts[i] + chains[i][exact - 1]) for i in range(SEGMENTS))), F.col("i") + 1)
    bits = F.element_at(F.array(*(F.lit(BITS - chains[i][exact - 1]) for i in range(SEGMENTS))), F.col("i") + 1)
    many = keys.where(F.col("n") > BUCKET).withColumn("from_", held).withColumn("bits_", bits)
    flips = F.expr("transform(sequence(0, bits_ - 1), j -> fp ^ shiftleft(1L, (from_ + j) % 64))")
    if max_diff == 1:  # only entries that are fingerprints themselves join what is one bit away
        flips = F.expr("array()").cast("array<bigint>")
    entries = many.select(*on, "fp", F.explode(F.concat(F.array(fp), flips)).alias("entry"))
    if max_diff == 1:
        near = many.select(*on, "fp", F.explode(F.expr("transform(sequence(0, bits_ - 1), j -> fp ^ shiftleft(1L, (from_ + j) % 64))")).alias("entry"))
        stars = near.join(entries.select(*on, F.col("entry"), F.col("fp").alias("other")), [*on, "entry"]).select(*by, F.col("fp").alias("a"), F.col("other").alias("b")).where("a < b")
    else:
        stars = entries.groupBy(*on, "entry").agg(F.collect_set("fp").alias("all_")).where(F.size("all_") > 1)
        stars = stars.select(*by, F.array_min("all_").alias("a"), F.explode("all_").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_diff: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest id reachable over links, the row's own included. Null
    text counts as empty (fingerprint 0, linked like any other); a null id keeps its row
    and is never a component_id unless all ids of the group are null; repeated rows and
    ids are kept as they are; an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col, width))
    each = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(links(each.select("fp"), max_diff))
    rooted = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = staged(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(groups, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


# Near copies by shingle similarity: SimHash and shared rare shingles link most, a join of shingle prefixes the rest.

PRINTS, STARS, WIDTH, LEAST = 2, 3, 5, 0.8
SAMPLED, HOT, PARITY, SHARE, CROWD = 16, 65_536, 1024, 512, 16
BROADCAST = 1_000_000  # numbers of texts with their keys, 24 bytes each, up to which they are broadcast
MIXERS = np.array([xxhash.xxh64_intdigest(b"print %d" % j) for j in range(PRINTS)], np.uint64)


def word_prints(raw: bytes) -> list[int]:
    """`PRINTS` independent fingerprints of a text's distinct words."""
    words = set(raw.lower().split())
    if not words:
        return [0] * PRINTS
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = []
    for mixer in MIXERS:
        x = (h ^ mixer) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        out.append(bit_majority(x ^ (x >> np.uint64(29))))
    return out


def shingle_hashes(raw: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles of `WIDTH` words, ascending."""
    parts = set(shingles(raw, WIDTH))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts)).view(np.int64))


def shingle_set(raw: bytes) -> tuple[list[int]]:
    return (shingle_hashes(raw).tolist(),)


def profiler(hot: list[int], least: float):
    """Per text: its fingerprints, the number, parities and prefix (in the common order) of its shingles, and its stars.

    The order is: shingles outside `hot` by hash, then those of `hot` as listed. Texts that
    are `least` alike share a shingle of their prefixes in any order; a text without words
    has the prefix [0]. Stars are the first `STARS` shingles of the text in `hot`, and as
    many outside: texts that are much alike are likely to share one.
    """
    values = np.array(hot, np.int64)
    by = np.argsort(values)
    ascending = values[by]

    def each(raw: bytes) -> tuple[list[int], int, list[int], list[int], list[int]]:
        h = shingle_hashes(raw)
        rank = np.zeros(len(h), np.int64)
        if len(ascending):
            at = np.minimum(np.searchsorted(ascending, h), len(ascending) - 1)
            rank = np.where(ascending[at] == h, by[at] + 1, 0)
        size = len(h) - math.ceil(least * len(h) - 1e-9) + 1
        parity = np.packbits((np.bincount(h & (PARITY - 1), minlength=PARITY) & 1).astype(bool)).view(np.int64)
        order = np.lexsort((h, rank))
        known = rank[order] > 0
        stars = np.r_[h[order[~known]][:STARS], h[order[known]][:STARS]]
        return word_prints(raw), len(h), parity.tolist(), h[order[:size]].tolist() or [0], stars.tolist()

    return each


def frequent(keyed: DataFrame) -> list[int]:
    """At most `HOT` shingles that many texts have, the rarest first, by a sample of texts.

    They only set the order of prefixes: what is missing here costs time, not pairs.
    """
    sample = per_row(keyed.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0), lambda: shingle_set, ["key"], "text", "key binary, parts array<bigint>")
    counts = sample.groupBy("key").agg(F.first("parts").alias("parts")).select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return [r.part for r in counts.where("n > 2").orderBy(F.desc("n"), "part").limit(HOT).collect()][::-1]


def compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From (hub, share, leaf, raw), each hub's own text before those of its leaves: the (hub, leaf) that are `least` alike."""
    hub, own = None, np.zeros(0, np.int64)
    for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
        out: list[tuple] = []
        for a, share, b, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (a, share) != hub:
                hub, own = (a, share), shingle_hashes(raw)
                continue
            its = shingle_hashes(raw)
            shared = len(np.intersect1d(own, its, assume_unique=True))
            if shared >= least * (len(own) + len(its) - shared):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    given_back()


def alike(texts: DataFrame, profiles: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of `pairs(a, b)` (numbers of texts) whose sets of shingles have a Jaccard similarity of `least` or more.

    Two sets differ in as many shingles at least as their parities in cells; pairs beyond
    what `least` allows are dropped first. The other pairs' texts meet at `a`, the hub, in
    shares of about `SHARE` leaves: a share holds the hub's set and reads one leaf after
    the other, so a hub of any size is spread, and a text moves once a pair.
    """
    brief = lambda k: profiles.select(F.col("uid").alias(k), F.struct("n", "parity").alias(k + "_"))
    differ = F.aggregate(F.zip_with("a_.parity", "b_.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    allowed = (1 - least) / (1 + least) * (F.col("a_.n") + F.col("b_.n")) + 1e-6
    pairs = staged(pairs.join(brief("a"), "a").join(brief("b"), "b").where(differ <= allowed).select("a", "b"))
    if pairs.isEmpty():
        return pairs
    released(pairs)
    wanted = staged(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct().join(profiles.select("key", "uid"), "uid"))
    held = texts.join(sized(wanted, BROADCAST), "key").groupBy(F.col("uid").alias("b")).agg(F.first("raw").alias("raw"))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    leaves = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b")
    seats = leaves.union(sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("b")))
    met = held.join(seats, "b").select("a", "share", "b", "raw").repartition("a", "share").sortWithinPartitions("a", "share", F.col("a") != F.col("b"))
    return staged(met.mapInArrow(lambda batches: compare(batches, least), "a bigint, b bigint"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair of two texts once, with one of its hubs as `a`."""
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    once = pairs.where("a <> b").select(low, high, "a").groupBy("low", "high").agg(F.min("a").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def met_tokens(profiles: DataFrame) -> DataFrame:
    """(token, uid, size): an entry per token of a prefix, of the tokens that several texts have.

    size is the number of the text's shingles and, below it, the token's place: n << 32 | at.
    """
    entries = profiles.select(F.posexplode("prefix").alias("at", "token"), "uid", F.shiftleft(F.col("n").cast("bigint"), 32).alias("n"))
    entries = entries.select("token", "uid", F.col("n").bitwiseOR(F.col("at").cast("bigint")).alias("size"))
    several = entries.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1").select("token")
    return staged(entries.join(several, "token"))


def undecided(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """`entries` with their text's group, of the tokens that stand in several groups."""
    rooted = entries.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("group", F.coalesce("root", "uid")).drop("root")
    several = rooted.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
    return staged(rooted.join(several, "token").select("token", "uid", "group", "size"))


def could_be(least: float):
    """Whether the first shared token of the prefixes of x and y leaves room for the similarity `least`, and both texts for each other."""
    n = lambda x: F.shiftright(f"{x}size", 32)
    left = lambda x: n(x) - F.col(f"{x}size").bitwiseAND(F.lit((1 << 32) - 1))
    return (F.least(left("x_"), left("y_")) >= least / (1 + least) * (n("x_") + n("y_")) - 1e-6) & (F.least(n("x_"), n("y_")) >= least * F.greatest(n("x_"), n("y_")) - 1e-6)


def crowded(entries: DataFrame, least: float) -> DataFrame:
    """(a, b): of each token that more than `CROWD` entries have, each entry's text with one other, if their groups differ."""
    side = lambda x: F.struct(*(F.col(c).alias(x + c) for c in ("uid", "group", "size")))
    hubs = entries.groupBy("token").agg(F.min_by(side("x_"), F.xxhash64("uid")).alias("hub"), F.count("*").alias("n")).where(F.col("n") > CROWD)
    pairs = entries.select("token", side("y_").alias("leaf")).join(hubs.select("token", "hub"), "token").select("hub.*", "leaf.*")
    return pairs.where((F.col("x_group") != F.col("y_group")) & could_be(least)).select(F.col("x_uid").alias("a"), F.col("y_uid").alias("b"))


def stars_of(profiles: DataFrame) -> DataFrame:
    """(a, b): each text with one other of those that share its fingerprint in a space, or one of its stars."""
    buckets = profiles.select("uid", F.posexplode(F.concat("fps", "stars")).alias("space", "value"))
    buckets = buckets.withColumn("space", F.least("space", F.lit(PRINTS)))
    hubs = buckets.groupBy("space", "value").agg(F.min_by("uid", F.xxhash64("uid")).alias("hub"), F.count("*").alias("n"))
    return buckets.join(hubs.where("n > 1"), ["space", "value"]).select(F.col("hub").alias("a"), F.col("uid").alias("b"))


def near_prints(profiles: DataFrame) -> DataFrame:
    """(a, b): one text of each two fingerprints of a space that are within two bits, by pigeonring chains."""
    spaces = profiles.select("uid", F.posexplode("fps").alias("space", "fp"))
    reps = staged(spaces.groupBy("space", "fp").agg(F.min_by("uid", F.xxhash64("uid")).alias("rep")))
    across = staged(links(reps.select("space", "fp"), 2, ("space",)))
    named = lambda k, name: reps.select("space", F.col("fp").alias(k), F.col("rep").alias(name))
    return across.join(named("a", "left_"), ["space", "a"]).join(named("b", "right_"), ["space", "b"]).select(F.col("left_").alias("a"), F.col("right_").alias("b"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, key, first_id, first_key) of each distinct row of `docs`: its group's first member.

    key is the MD5 of the text. Rows with equal texts are one text; two texts are linked
    where their sets of five-word shingles have a Jaccard similarity of `least` or more,
    and linked texts are a group. Groups are exact. First most copies are linked cheaply:
    texts whose fingerprints of distinct words are within two bits in one of `PRINTS`
    independent spaces, and texts that share a star, each compared with one other only.
    The same is done with the shingles of prefixes that a crowd of texts shares, as long as
    that links a hundredth of the texts. Then every two texts that share a shingle of their prefixes are compared,
    unless they are in one group by then. The first member has the smallest id (nulls last), then key.
    Null text counts as empty; empty tables give empty results.
    """
    raw = raw_text(text_col)
    key = F.unhex(F.md5(raw)).alias("key")
    rows = staged(docs.select(F.col(id_col).alias("id"), key).distinct())
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(key, raw.alias("raw"))
    keyed = docs.select(key, F.col(text_col).alias("text"))
    hot = frequent(keyed)
    profiles = per_row(keyed, lambda: profiler(hot, least), ["key"], "text", "key binary, fps array<bigint>, n int, parity array<bigint>, prefix array<bigint>, stars array<bigint>")
    names = ["fps", "n", "parity", "prefix", "stars"]
    profiles = profiles.groupBy("key").agg(F.first(F.struct(*names)).alias("p")).select("key", "p.*")
    profiles = staged(profiles.withColumn("uid", F.monotonically_increasing_id()))
    released(docs)
    linked = alike(texts, profiles, ordered(stars_of(profiles).union(near_prints(profiles))), least)
    edges = lambda: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    few = 1 + profiles.count() // 100
    roots, entries = connected_components(linked), met_tokens(profiles)
    while True:  # large groups of copies collapse further before their texts are compared in pairs
        released(docs)
        apart = undecided(entries, roots)
        linked = alike(texts, profiles, ordered(crowded(apart, least)), least)
        if linked.count() < few:
            break
        roots = connected_components(edges().union(linked))

    side = lambda x: apart.select("token", *(F.col(c).alias(x + c) for c in ("uid", "group", "size")))
    near = side("x_").join(side("y_"), "token").where((F.col("x_uid") < F.col("y_uid")) & (F.col("x_group") != F.col("y_group")) & could_be(least))
    linked = linked.union(alike(texts, profiles, ordered(near.select(F.col("x_uid").alias("a"), F.col("y_uid").alias("b"))), least))
    released(docs)

    roots = connected_components(edges().union(linked))
    named = profiles.select("key", "uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("key", F.coalesce("root", "uid").alias("root"))
    rooted = staged(rows.join(named, "key"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = rooted.groupBy("root").agg(F.min(order).alias("first"))
    return rooted.join(first, "root").select(F.col("id").cast(kind).alias(id_col), "key", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """`docs` with one row of each group of `copies`, its first member; repeated rows become one."""
    first = copies(docs, id_col, text_col, least).where(F.col(id_col).eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    first = staged(first.select(F.col(id_col).alias("id__"), F.col("key").alias("key__")))
    keyed = docs.withColumn("own__", F.unhex(F.md5(raw_text(text_col))))
    kept = keyed.join(first, keyed[id_col].eqNullSafe(first["id__"]) & (keyed["own__"] == first["key__"]), "left_semi")
    return kept.dropDuplicates([id_col, "own__"]).drop("own__")
