"""Fill-in-the-middle: seeded cuts of every text, over an index of distinct texts.

Identical texts are grouped once. Tasks drop the repeats that they see themselves, the
rest meet by SHA-256 and are told apart by their content. The ends of a text's tokens are a
rising sequence, stored once per distinct text as an Elias-Fano list: the low bits of each
end side by side, the high bits as gaps in unary. Documents join the index by their key
without their text, and each one's two seeded cuts are selected from the list.

A text that more than `SHARE` different ids have is sent, with its list, to several seats,
each of which cuts a share of its documents; texts move once otherwise.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import AT_ONCE, raw_text, staged

SHARE, SEED, PLAIN, SPM = 256, 42, 50, 80
P, S, M = b"<P>", b"<S>", b"<M>"
HEAD = struct.Struct("<QQB")
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_ends(raw: bytes) -> np.ndarray:
    """Where each token ends, in bytes: at a word's last byte, and at the end of white space that no word follows."""
    if not raw:
        return np.zeros(0, np.int64)
    space = SPACE[np.frombuffer(raw, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(raw))  # a last word, or the white space after it


def elias_fano(values: np.ndarray) -> bytes:
    """A rising sequence of integers above 0 in about 2 + log2(last / count) bits each."""
    count, last = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (last // count).bit_length() - 1) if count else 0
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros((last >> width) + count + 1, np.uint8)
    high[(values >> width) + np.arange(count)] = 1
    return HEAD.pack(count, last, width) + np.packbits(low.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


class Boundaries:
    """Reads a list that `elias_fano` wrote, without unpacking it."""

    def __init__(self, stored: bytes):
        self.count, _, self.width = HEAD.unpack_from(stored)
        split = HEAD.size + (self.count * self.width + 7) // 8
        self.low = np.frombuffer(stored[HEAD.size : split], np.uint8)
        self.high = np.frombuffer(stored[split:], np.uint8)
        self.before = np.cumsum(ONES[self.high])

    def end(self, units: int) -> int:
        """Bytes that the first `units` tokens hold."""
        if not units:
            return 0
        i = units - 1
        byte = int(np.searchsorted(self.before, units))
        rest = units - (int(self.before[byte - 1]) if byte else 0)
        place = 8 * byte + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[rest - 1])
        bits = np.arange(i * self.width, (i + 1) * self.width)
        low = int((((self.low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) << np.arange(self.width)).sum())
        return (place - i) << self.width | low


def characters(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))


def draws(ident: str) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{SEED}:{ident}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def restored(output: bytes, form: str) -> bytes:
    """The text that `output` was made of."""
    if form == "plain":
        return output
    first, second = (P, S) if form == "psm" else (S, P)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(M, 1)
    return a + middle + b if form == "psm" else b + middle + a


def transformed(raw: bytes, bounds: Boundaries, ident: str, marked: bool) -> tuple[str, bytes, int | None, int | None]:
    """Form, output, and the code points of prefix and middle of one document."""
    h1, h2, h3, h4 = draws(ident)
    if marked or h3 % 100 >= PLAIN:
        return "plain", raw, None, None
    cuts = sorted((h1 % (bounds.count + 1), h2 % (bounds.count + 1)))
    a, b = (bounds.end(x) for x in cuts)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < SPM:
        return "spm", S + suffix + P + prefix + M + middle, characters(prefix), characters(middle)
    return "psm", P + prefix + S + suffix + M + middle, characters(prefix), characters(middle)


def cut_each(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """From (raw, bounds, ids with their number of rows) to one row per id."""
    names = ["id", "times", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * keep
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep
    made = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
    for batch in batches:
        out, held = [], 0
        for row in range(batch.num_rows):
            raw, stored, ids = (batch.column(i)[row].as_py() for i in range(3))
            bounds, marked = Boundaries(stored), not raw or any(x in raw for x in (P, S, M))
            for ident, times in ((x["id"], x["times"]) for x in ids):
                form, output, prefix, middle = transformed(raw, bounds, ident or "", marked)
                back = restored(output, form)
                out.append((ident, times, bounds.count, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest(), *[output] * keep))
                held += len(output) * keep
                if len(out) >= 16 * AT_ONCE or held > 1 << 24:
                    yield made(out)
                    out, held = [], 0
        yield made(out)


def once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, raw) whose key the task hasn't seen."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


@F.pandas_udf(BinaryType())
def boundary_list(raw: pd.Series) -> pd.Series:
    """The Elias-Fano list of a text's token ends."""
    return raw.map(lambda x: elias_fano(token_ends(bytes(x))))


def text_index(docs: DataFrame, text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(key, raw): each distinct text once, dealt by its SHA-256.

    Texts of one key are compared by content: should two differ, which no one has seen,
    the job fails rather than mix them up.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = raw_text(text_col)
    texts = docs.select(F.unhex(F.sha2(raw, 256)).alias("key"), raw.alias("raw")).mapInArrow(once_a_task, "key binary, raw binary")
    texts = texts.repartition(partitions, "key").distinct()
    alone = F.count("*").over(Window.partitionBy("key")) == 1
    return texts.withColumn("one", F.when(alone, True).otherwise(F.raise_error(F.lit("texts of one SHA-256 differ")).cast("boolean"))).where("one").select("key", "raw")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, keep_output: bool = False) -> DataFrame:
    """Per row of `docs`: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; with `keep_output` the output too (binary).

    A text is cut after two seeded numbers of its tokens; half of the texts stay plain, and
    all that are empty or hold a marker. Null text counts as empty (no tokens, plain); a
    null id draws as an empty one. Draws follow the id alone, so rows equal in id and text
    give equal rows, as many as there are. Very long texts are cut whole. Ids may be of any type
    that a text can be cast to and from; other columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    raw = raw_text(text_col)
    rows = docs.select(F.unhex(F.sha2(raw, 256)).alias("key"), F.col(id_col).cast("string").alias("id"))
    rows = rows.groupBy("key", "id").agg(F.count("*").alias("times"))
    shares = rows.groupBy("key").agg(F.ceil(F.count("*") / share).alias("shares"))
    seat = F.pmod(F.xxhash64("id"), F.col("shares")).alias("seat")
    seats = staged(rows.join(shares, "key").groupBy("key", "shares", seat).agg(F.collect_list(F.struct("id", "times")).alias("ids")))
    index = text_index(docs, text_col)
    few = index.join(seats.where("shares = 1"), "key").withColumn("bounds", boundary_list("raw"))  # lists after the join, which keeps the index where it is
    spread = index.join(seats.where("shares > 1").select("key", "shares").distinct(), "key").withColumn("bounds", boundary_list("raw"))
    spread = spread.select("key", "raw", "bounds", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("seat"))
    spread = spread.repartition("key", "seat")
    many = spread.join(seats.where("shares > 1").select("key", "seat", "ids"), ["key", "seat"])
    schema = "id string, times bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + ", output binary" * keep_output
    cut = lambda joined: joined.select("raw", "bounds", "ids").mapInArrow(lambda batches: cut_each(batches, keep_output), schema)
    made = cut(few).unionByName(cut(many))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("copy")
    return made.select(F.col("id").cast(kind).alias(id_col), *made.columns[2:], copies).drop("copy")
