"""License scans: MinHash bands over text windows retrieve templates, shingles verify them.

Texts and templates are sequences of words (letters and digits in lower case) and their
shingles of `WIDTH` words; notices are as short as five words, hence three. Windows of
`WINDOW` shingles start every `STRIDE`, so that any `PIECE` consecutive shingles of a
template lie in one window of a text. Templates give windows of `PIECE` to `WINDOW`
shingles from every position: a piece that stands unchanged in a text is then at least
PIECE / WINDOW alike to one of them, and wholly alike if it is as long as a window and
its text window. A band is one minimum under a hash of its own; `bands_for` gives the
number that finds such a window with the certainty asked for, and a template of n shingles
has about n / STRIDE windows to be found by.

Windows are rows, whose minima are plain expressions; each minimum meets the band table,
which is broadcast and whose size is checked. Collisions retrieve templates: a few pairs of
a window and a template per text, that go back to it by the text's MD5. There the share of
the template's shingles that stand near the window must reach `least`.
"""

from __future__ import annotations

import json
import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, staged
from .license_texts import NOTICES, TEXTS

WIDTH, PIECE, WINDOW, STRIDE, CERTAINTY = 3, 3, 5, 3, 0.999
MOST, BROADCAST = 1_000_000, 100_000  # entries of the band table: some 16 MB; texts with a collision, up to which these are broadcast

TEMPLATES = TEXTS + NOTICES


def bands_for(similarity: float, certainty: float) -> int:
    """How many minima two sets of this Jaccard similarity need to share one with this certainty."""
    return math.ceil(math.log(1 - certainty) / math.log(1 - similarity))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[str]) -> list[int]:
    """Signed hashes of a template's shingles, as `text_shingles` gives for texts."""
    return [signed(xxhash.xxh64_intdigest(" ".join(words[i : i + WIDTH]), 42)) for i in range(len(words) - WIDTH + 1)]


def banded(shingle: int, band: int) -> int:
    """The hash of a shingle in a band, as Spark's xxhash64(shingle, band)."""
    first = xxhash.xxh64_intdigest(shingle.to_bytes(8, "little", signed=True), 42)
    return signed(xxhash.xxh64_intdigest(band.to_bytes(8, "little", signed=True), first))


def text_words(text: Column) -> Column:
    """Letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def text_shingles(text: Column) -> Column:
    """Hashes of the shingles of a text's words; fewer than `WIDTH` words: none."""
    joined = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + j) for j in range(WIDTH)))))
    return let(text_words(text), lambda w: F.when(F.size(w) >= WIDTH, joined(w)).otherwise(F.array().cast("array<bigint>")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbers(values: list[list[int]]) -> Column:
    """An array of arrays that is read from one text, and so folded to a single literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<array<bigint>>")


def band_table(templates: list[list[int]], bands: int) -> dict[int, set[int]]:
    """By minimum the templates, given as lists of shingle hashes, that have a window with it."""
    found: dict[int, set[int]] = {}
    for t, shingles in enumerate(templates):
        for band in range(bands):
            h = [banded(x, band) for x in shingles]
            for start in range(len(h) - PIECE + 1):
                for size in range(PIECE, min(WINDOW, len(h) - start) + 1):
                    found.setdefault(min(h[start : start + size]), set()).add(t)
    if sum(map(len, found.values())) > MOST:
        raise ValueError(f"the templates make a band table of more than {MOST} entries")
    return found


def rivals(templates: list[tuple[str, set[int]]], least: float) -> list[list[str]]:
    """Per template the other licenses that have a template with `least` of the shingles of the shorter of the two in common."""
    out = []
    for name, own in templates:
        near = {other for other, its in templates if other != name and len(own & its) >= least * min(len(own), len(its))}
        out.append(sorted(near))
    return out


def retrieved(keyed: DataFrame, templates: list[list[int]]) -> DataFrame:
    """(key__, w, t): the w-th window of a text of `keyed(key__, text__)`, one of whose minima is that of a window of template t."""
    bands = bands_for(PIECE / WINDOW, CERTAINTY)
    entries = [(low, t) for low, some in band_table(templates, bands).items() for t in some]
    table = keyed.sparkSession.createDataFrame(entries, "low bigint, t bigint")
    texts = keyed.select("key__", text_words(F.col("text__")).alias("words")).where(F.size("words") >= WIDTH + PIECE - 1)
    windows = texts.select("key__", "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - WIDTH) / STRIDE).cast("int"))).alias("w"))
    word = lambda i: F.get("words", F.col("w") * STRIDE + i)
    shingle = lambda i: F.when(word(i + WIDTH - 1).isNotNull(), F.xxhash64(F.concat_ws(" ", *(word(i + j) for j in range(WIDTH)))))
    windows = windows.select("key__", "w", *(shingle(i).alias(f"s{i}") for i in range(WINDOW)))
    banded_ = lambda i, band: F.when(F.col(f"s{i}").isNotNull(), F.xxhash64(f"s{i}", F.lit(band).cast("bigint")))
    minima = F.array(*(F.least(*(banded_(i, band) for i in range(WINDOW))) for band in range(bands)))
    return windows.select("key__", "w", F.explode(minima).alias("low")).join(F.broadcast(table), "low").select("key__", "w", "t").distinct()


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """Per row of `docs`: id, matches (array of license, first_shingle, containment; by license), licenses, n_licenses.

    A license matches where at least `least` of the shingles of one of its templates stand
    together: as near to a window that retrieved it as the template is long. first_shingle
    is the start of the earliest such window and containment the highest share found. Of
    licenses whose templates hold most of one another (BSD with two and three clauses) the
    one with the highest containment matches, of equal ones the longest. `licenses` joins
    the names by commas ('' if none). Null and empty texts match nothing; very long texts
    are scanned whole; null or repeated ids keep their rows; an empty table gives an empty
    result; other columns are not read. Templates need WIDTH + PIECE - 1 words or more.
    """
    words = [template_words(text) for _, text in templates]
    if any(len(w) < WIDTH + PIECE - 1 for w in words):
        raise ValueError(f"a template has fewer than {WIDTH + PIECE - 1} words")
    ordered = [shingle_hashes(w) for w in words]
    sets = [(name, set(h)) for (name, _), h in zip(templates, ordered, strict=True)]
    own = numbers([sorted(h) for _, h in sets])
    text = F.coalesce(text_col, F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("text__"), F.unhex(F.md5(text.cast("binary"))).alias("key__"))
    pairs = retrieved(keyed, ordered).groupBy("key__").agg(F.collect_set(F.struct("w", "t")).alias("pairs"))
    hits = sized(staged(pairs), BROADCAST)

    def verified(h: Column, p: Column) -> Column:
        size = F.size(F.element_at(own, (p["t"] + 1).cast("int")))
        start = F.greatest(p["w"] * STRIDE - size, F.lit(0))
        near = F.slice(h, start + 1, p["w"] * STRIDE + WINDOW + size - start)
        share = F.size(F.array_intersect(F.element_at(own, (p["t"] + 1).cast("int")), near)) / size
        return F.struct(share.alias("share"), size.alias("size"), (p["w"] * STRIDE).alias("at"), p["t"].alias("t"))

    scan = lambda h: F.filter(F.transform("pairs", lambda p: verified(h, p)), lambda v: v["share"] >= least)
    names = F.array(*(F.lit(n) for n, _ in templates))
    against = F.array(*(F.array(*map(F.lit, r)).cast("array<string>") for r in rivals(sets, least)))
    license_of = lambda v: F.element_at(names, (v["t"] + 1).cast("int"))

    def summed(found: Column) -> Column:
        best = lambda some: F.array_max(F.transform(some, lambda v: F.struct(v["share"], v["size"])))
        beaten = lambda v: F.exists(found, lambda o: F.array_contains(F.element_at(against, (v["t"] + 1).cast("int")), license_of(o)) & (F.struct(o["share"], o["size"]) > F.struct(v["share"], v["size"])))
        top = lambda name: best(F.filter(found, lambda v: license_of(v) == name))
        strongest = F.filter(found, lambda v: (F.struct(v["share"], v["size"]) == top(license_of(v))) & ~beaten(v))
        each = F.array_sort(F.array_distinct(F.transform(strongest, license_of)))
        mine = lambda name: F.filter(found, lambda v: license_of(v) == name)
        return F.transform(each, lambda n: F.struct(n.alias("license"), F.array_min(F.transform(mine(n), lambda v: v["at"])).alias("first_shingle"), F.array_max(F.transform(mine(n), lambda v: v["share"])).alias("containment")))

    none = F.array().cast("array<struct<license:string,first_shingle:int,containment:double>>")
    matches = F.when(F.col("pairs").isNull(), none).otherwise(let(text_shingles(F.col("text__")), lambda h: let(scan(h), summed)))
    rows = keyed.join(hits, "key__", "left").select(id_col, matches.alias("matches"))
    return rows.select(id_col, "matches", F.array_join(F.col("matches.license"), ",").alias("licenses"), F.size("matches").cast("long").alias("n_licenses"))
