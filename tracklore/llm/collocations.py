"""Phrase collocations by contiguous pattern growth over projected occurrences.

Frequent words come first, counted with partial sums. Each occurrence of one is then a
pointer with its projection: the frequent words that follow it within its piece, up to the
longest phrase. Pointers are dealt by their prefix, the first word, to units; a unit's task
holds the pointers of its prefixes only and grows each to the right depth-first: the sorted
pointers of a prefix are a range, those of its extensions are ranges inside, and a range
that holds too few occurrences isn't entered.

Pointers with equal words are counted together before they move. There are as many units as
the words ask for, and words that alone would fill a unit are dealt by pairs of words from
the start. A unit that still holds more than `limit` pointers is dealt again by prefixes
one word longer, until it fits; the prefixes that were left behind are counted while that is
done. So no task holds more than `limit` pointers, whatever share of the corpus begins with
one word or word pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import AT_ONCE, raw_text, sized, staged

LEAST, LONGEST, TOP = 100, 5, 2000
LIMIT, BLOCK, FLUSH, SLOTS, SEED = 1_000_000, 4_000_000, 16_000_000, 1 << 25, 42
UNITS, FEWEST, SHARE, LISTED, KNOWN = 256, 256, 4, 100_000, 1 << 20
#: A-Z in lower case, tabs as spaces, and what ends a piece as line feeds.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
POINTERS = "lang string, unit bigint, n bigint, words binary, pointers binary"
PHRASES = "lang string, phrase string, size int, a bigint"


class Ids(dict):
    """Numbers words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(raw: bytes) -> Iterator[bytes]:
    """A text in normal form, in blocks of about `BLOCK` bytes that end where a piece does."""
    text, start = raw.translate(PLAIN), 0
    while start < len(text):
        end = len(text)
        if end - start > BLOCK:
            end = text.rfind(b"\n", start, start + BLOCK) + 1 or text.find(b"\n", start + BLOCK) + 1 or end
        yield text[start:end]
        start = end


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """From (lang, raw): (lang, words, numbers) of some texts at a time; 0 stands between pieces, 1 isn't used."""
    held: dict[str, tuple[Ids, list[np.ndarray]]] = {}
    size = 0

    def flushed():
        for lang, (ids, parts) in held.items():
            numbers = np.concatenate(parts)
            yield lang, list(ids), numbers[numbers != 1]
        held.clear()

    for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for block in blocks(raw):
                ids, parts = held.setdefault(lang, (Ids({b"\n": 0, b"": 1}), []))
                words = block.replace(b"\n", b" \n ").split(b" ")
                parts += [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
                size += len(block)
                if size >= FLUSH:
                    yield from flushed()
                    size = 0
    yield from flushed()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) with partial counts, and one row without a word that counts all words."""
    for lang, words, numbers in numbered(batches):
        counts = np.bincount(numbers, minlength=len(words))[2:]
        names = pa.array([w.decode("utf-8", "replace") for w in words[2:]] + [None], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, pa.array([*counts.tolist(), int(counts.sum())], pa.int64())], names=["lang", "word", "n"])


def slot_of(lang: str, words: list[bytes]) -> np.ndarray:
    """The slot of each word, as `pmod(xxhash64(lang, word), SLOTS)` gives it."""
    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) & (SLOTS - 1) for w in words), np.int64, len(words))


def word_slots(frequent: DataFrame) -> np.ndarray:
    """Bits of the slots that frequent words have: `SLOTS` bits (4 MB), however many words.

    A rare word that shares a slot is let through; growth counts it and stops there.
    """
    slot = F.pmod(F.xxhash64("lang", "word"), F.lit(SLOTS))
    cells = frequent.select(F.floor(slot / 8).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int")).alias("bit"))
    cells = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 8, np.uint8)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out


def merged(pointers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of `pointers`, ascending, with the sums of their counts."""
    if not len(pointers):
        return pointers, counts
    width = pointers.shape[1]
    keys = [pointers[:, j].astype(np.int64) << 32 | (pointers[:, j + 1] if j + 1 < width else 0) for j in range(0, width, 2)]
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    changed[0] = True
    for key in keys:
        key = key[order]
        changed[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(changed)
    return pointers[order[starts]], np.add.reduceat(counts[order], starts)


def packed(words: list[bytes], pointers: np.ndarray, counts: np.ndarray, shared: bool = False) -> tuple[int, bytes, bytes]:
    """Number of pointers, the words they use, and their words' places and counts, by column and byte.

    If all tasks share the words, there are none to pack and places are those of `words`.
    """
    pack = zstandard.ZstdCompressor(level=1).compress
    names = b""
    if not shared:
        used, places = np.unique(pointers, return_inverse=True)
        shift = int(used[0] != 0)  # place 0 is no word
        names = pack(b" ".join(words[i] for i in used[1 - shift :].tolist()))
        pointers = (places + shift).reshape(pointers.shape)
    columns = np.ascontiguousarray(np.vstack([pointers.T, counts[None]]).astype("<u4"))
    planes = columns.view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    return len(pointers), names, pack(np.ascontiguousarray(planes).tobytes())


def unpacked(n: int, names: bytes, columns: bytes, words: list[bytes] | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words (the first of them none), pointers as places among them, counts; `words` are those that all tasks share."""
    unpack = zstandard.ZstdDecompressor().decompress
    planes = np.frombuffer(unpack(columns), np.uint8).reshape(-1, 4, n).transpose(0, 2, 1)
    table = np.ascontiguousarray(planes).view("<u4")[..., 0]
    return words or [b"", *unpack(names).split(b" ")], table[:-1].T.astype(np.int32), table[-1].astype(np.int64)


def dealt(lang: str, words: list[bytes], pointers: np.ndarray, counts: np.ndarray, depth: int, unit: int = 0, units: int = UNITS, hot: np.ndarray | None = None, shared: bool = False) -> Iterator[tuple]:
    """Rows of `POINTERS`, by the hash of the first `depth` words, below `unit`; `pointers` are sorted and have as many words.

    `hot` marks words that lengthen the prefix by the one that follows them.
    """
    if not len(pointers):
        return
    new = np.r_[True, (pointers[1:, :depth] != pointers[:-1, :depth]).any(axis=1)]
    if hot is not None:
        new[1:] |= hot[pointers[1:, depth - 1]] & (pointers[1:, depth] != pointers[:-1, depth])
    seed = xxhash.xxh64_intdigest(lang.encode(), depth)
    length = lambda p: depth + (hot is not None and bool(hot[p[depth - 1]]))
    hashes = [xxhash.xxh64_intdigest(b" ".join([words[i] for i in p[: length(p)]]), seed) % units for p in pointers[new, : depth + 1].tolist()]
    units_of_rows = np.repeat(np.array(hashes), np.diff(np.r_[np.flatnonzero(new), len(pointers)]))
    order = np.argsort(units_of_rows, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(units_of_rows[order]) > 0])
    for i, j in zip(starts, [*starts[1:], len(order)], strict=True):
        rows = order[i:j]
        yield (lang, unit * units + int(units_of_rows[rows[0]]), *packed(words, pointers[rows], counts[rows], shared))


def batch_of(rows: list[tuple], schema: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], names=[f.name for f in schema])


def fields(ddl: str) -> list[pa.Field]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return [pa.field(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")]


def shared_words(frequent: DataFrame, limit: int) -> dict[str, tuple[list[bytes], int]] | None:
    """Per language its frequent words, the most frequent first behind none, and how many of them are hot; None if all are more than `KNOWN`."""
    if frequent.count() > KNOWN:
        return None
    rows = frequent.orderBy("lang", F.desc("n"), "word").toArrow()
    out: dict[str, tuple[list[bytes], int]] = {}
    for lang, word, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        words, hot = out.get(lang, ([b""], 0))
        words.append(word.encode())
        out[lang] = (words, hot + (2 * n > limit))
    return out


def project(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None, hot: np.ndarray | None, shared, longest: int, units: int) -> Iterator[pa.RecordBatch]:
    """From (lang, raw): the pointers of frequent words that a frequent word follows, by their first word, or two if the first is hot.

    Words are known from the broadcast `shared`, or else by the bits of `frequent` and `hot`.
    """
    schema, known = fields(POINTERS), {}
    for lang, words, numbers in numbered(batches):
        if shared:
            all_, many = shared.value.get(lang, ([b""], 0))
            places = known.setdefault(lang, {w: i for i, w in enumerate(all_)} if lang not in known else None)
            kept = np.fromiter((places.get(w, 0) for w in words), np.int32, len(words))
            kept[:2] = 0
            numbers, words, filling = kept[numbers], all_, np.arange(len(all_)) <= many
        else:
            slots = slot_of(lang, words)
            kept, filling = ((bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool) for bits in (frequent, hot))
            kept[:2] = False
            numbers = np.where(kept[numbers], numbers, 0)
        at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        padded = np.r_[numbers, np.zeros(longest, np.int32)]
        pointers = np.empty((len(at), longest), np.int32)
        alive = np.ones(len(at), bool)
        for j in range(longest):
            column = padded[at + j]
            alive &= column > 0
            pointers[:, j] = np.where(alive, column, 0)
        pointers, counts = merged(pointers, np.ones(len(at), np.int64))
        rows = dealt(lang, words, pointers, counts, 1, 0, units, filling, bool(shared))
        while some := list(islice(rows, AT_ONCE)):
            yield batch_of(some, schema)


def units_of(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """Runs of rows of one (lang, unit), as unpacked pointers."""
    rows = ((x["lang"], x["unit"], x["n"], x["words"], x["pointers"]) for batch in batches for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist())
    for key, run in groupby(rows, key=lambda x: x[:2]):
        yield key, (unpacked(*x[2:], shared.value[x[0]][0] if shared else None) for x in run)


def gathered(run: Iterator[tuple], same: bool, limit: int | None = None) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """The merged pointers of a run, whose rows have the same words or not; with a limit, in parts of about as many distinct ones."""
    ids, parts, counts, held = Ids({b"": 0}), [], [], 0
    names = lambda: words if same else list(ids)

    def joined():
        return merged(np.concatenate(parts), np.concatenate(counts))

    for words, pointers, n in run:
        parts.append(pointers if same else np.fromiter(map(ids.__getitem__, words), np.int32, len(words))[pointers])
        counts.append(n)
        held += len(n)
        if held >= 2 * (limit or LIMIT):
            both = joined()
            if limit and len(both[0]) >= limit:
                yield names(), *both
                ids, parts, counts, held = Ids({b"": 0}), [], [], 0
            else:
                parts, counts = [both[0]], [both[1]]
                held = len(both[0]) if limit else 0
    if parts:
        yield names(), *joined()


def grown(words: list[bytes], pointers: np.ndarray, counts: np.ndarray, least: int, shortest: int) -> Iterator[tuple[str, int, int]]:
    """Phrases of `shortest` words or more that `least` of the sorted pointers begin with, depth-first: (phrase, words, occurrences)."""
    before = np.r_[0, np.cumsum(counts)]
    todo = [(0, len(pointers), b"", 0)]
    while todo:
        low, high, prefix, size = todo.pop()
        column = pointers[low:high, size]
        starts = np.r_[0, np.flatnonzero(np.diff(column)) + 1] + low
        ends = np.r_[starts[1:], high]
        sums = before[ends] - before[starts]
        for i in np.flatnonzero((sums >= least) & (pointers[starts, size] > 0)).tolist():
            word = words[pointers[starts[i], size]]
            phrase = prefix + b" " + word if size else word
            if size + 1 >= shortest:
                yield phrase.decode("utf-8", "replace"), size + 1, int(sums[i])
            if size + 1 < pointers.shape[1]:
                todo.append((int(starts[i]), int(ends[i]), phrase, size + 1))


def mine(batches: Iterator[pa.RecordBatch], depth: int, least: int, shared) -> Iterator[pa.RecordBatch]:
    """The frequent phrases of units, whose prefixes have `depth` words."""
    schema = fields(PHRASES)
    for (lang, _), run in units_of(batches, shared):
        for words, pointers, counts in gathered(run, bool(shared)):
            rows = [(lang, *x) for x in grown(words, pointers, counts, least, max(2, depth))]
            for i in range(0, len(rows), 10_000):
                yield batch_of(rows[i : i + 10_000], schema)


def lengthen(batches: Iterator[pa.RecordBatch], depth: int, limit: int, shared) -> Iterator[pa.RecordBatch]:
    """Deals units again by prefixes of one word more; also partial counts of the prefixes of `depth` words, if 2 or more."""
    schema = fields(f"{POINTERS}, {PHRASES.split(', ', 1)[1]}")
    for (lang, unit), run in units_of(batches, shared):
        for words, pointers, counts in gathered(run, bool(shared), limit):
            rows = [(*x, None, None, None) for x in dealt(lang, words, pointers[pointers[:, depth] > 0], counts[pointers[:, depth] > 0], depth + 1, unit, shared=bool(shared))]
            if depth > 1:
                heads, sums = merged(pointers[:, :depth], counts)
                rows += [(lang, None, None, None, None, b" ".join([words[i] for i in p]).decode("utf-8", "replace"), depth, n) for p, n in zip(heads.tolist(), sums.tolist(), strict=True)]
            for i in range(0, len(rows), AT_ONCE):
                yield batch_of(rows[i : i + AT_ONCE], schema)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of 1 to `longest` words that occur `least` times, and (lang, n), the words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), raw_text(text_col).alias("raw"))
    counted = texts.mapInArrow(count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = staged(counted.where((F.col("n") >= least) | F.col("word").isNull()))
    single = counted.where("word IS NOT NULL")
    total = counted.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    units = FEWEST
    while units * limit < SHARE * total and units < 1 << 14:
        units *= 2
    shared, slots, hot = shared_words(single, limit), None, None
    if shared is None:  # more words than can be broadcast: rows bring their own
        slots, hot = word_slots(single), word_slots(single.where(F.col("n") * 2 > limit))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(shared)
    pointers, found = staged(texts.mapInArrow(lambda batches: project(batches, slots, hot, shared, longest, units), POINTERS)), []
    for depth in range(1, longest + 1):
        large = pointers.groupBy("lang", "unit").agg(F.sum("n").alias("n")).where((F.col("n") > limit) & F.lit(depth < longest)).select("lang", "unit")
        large = sized(staged(large), LISTED)
        split = not large.isEmpty()
        fitting = pointers.join(large, ["lang", "unit"], "left_anti") if split else pointers
        sorted_ = lambda df: df.repartition("lang", "unit").sortWithinPartitions("lang", "unit")
        found.append(sorted_(fitting).mapInArrow(lambda batches, depth=depth: mine(batches, depth, least, shared), PHRASES))
        if not split:
            break
        longer = sorted_(pointers.join(large, ["lang", "unit"], "left_semi"))
        longer = staged(longer.mapInArrow(lambda batches, depth=depth: lengthen(batches, depth, limit, shared), f"{POINTERS}, {PHRASES.split(', ', 1)[1]}"))
        found.append(longer.where("unit IS NULL").select("lang", "phrase", "size", "a"))
        pointers = longer.where("unit IS NOT NULL").select(*pointers.columns)
    phrases = single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("a"))
    for part in found:
        phrases = phrases.union(part)
    phrases = phrases.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return staged(phrases), counted.where("word IS NULL").select("lang", "n")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best `top` phrases of each language, or of all with None.

    a, l and r are the occurrences of the phrase and of the two parts of its worst cut, n
    the words of the language, score is floor(1000 a n / (l r)), in whole numbers. A phrase
    goes if one that holds it occurs as often: it is enough to look at those that are one
    word longer, as occurrences can only fall on the way to any longer one. Ties of cuts go
    to the shorter first part, ties of scores to more occurrences, then by the phrase's bytes.

    Null text counts as empty, a null language is `und`; repeated rows count again. Pieces
    of any length are whole (a block ends where a piece does). Other columns are not read.
    Tables without a frequent phrase give an empty result.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, least, longest, limit)
    several = phrases.where("size > 1").withColumn("words", F.split("phrase", " ")).join(totals, "lang")
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    counted = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(counted("first", "l"), ["lang", "first"]).join(counted("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = several.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    ranked = kept.withColumn("rank", rank)
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
