"""Document fingerprints: sets of content-defined chunk digests weighted by length.

Each text is cut where a gear hash says so, so an edit changes the chunks near it and no
others. A fingerprint lists the digests with the bytes they stand for; the share of a
text's bytes whose chunks another text also has measures containment.

Comparing each text with the next one needs the order of all ids. Ids and hashes alone are
dealt to ranges first, which gives each range's first row; each text moves once, to the partition of its range, and the first text of
each range also goes to the range before it. No task sees more than its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_text
from .gear import cuts

LEAST, NORMAL, MOST = 16, 64, 256


def chunk_weights(raw: bytes) -> dict[int, int]:
    """48-bit digest of each distinct chunk, with the bytes that its occurrences hold."""
    found: dict[int, int] = {}
    start = 0
    for end in cuts(raw, LEAST, NORMAL, MOST):
        digest = xxhash.xxh64_intdigest(raw[start:end]) >> 16
        found[digest] = found.get(digest, 0) + end - start
        start = end
    return found


def as_text(weights: dict[int, int]) -> str:
    """`digest:bytes` pairs in order of the digest; empty for an empty text."""
    return ",".join(f"{d:012x}:{weights[d]}" for d in sorted(weights))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes whose chunks b has too, each as often as both have it; two empty sets: 1."""
    if not a:
        return float(not b)
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / sum(a.values())


def compare_with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, ghost, id): compares each row that isn't a ghost with the row after it."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before = None

    def compared(ident, raw: bytes, own: dict, after: bytes, its: dict) -> tuple:
        text = raw.decode("utf-8", "replace")
        n = len(text)
        edited = (text[: n - n // 2] + after.decode("utf-8", "replace")[: n // 2]).encode()
        new = chunk_weights(edited)
        return (ident, n, hashlib.sha256(edited).hexdigest(), as_text(own), as_text(new), containment(own, new), containment(own, its))

    for batch in batches:
        kinds[0] = batch.column(2).type
        out: list[tuple] = []
        for part, ghost, ident, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = chunk_weights(raw)
            if before is not None and before[0] == part:
                out.append(compared(*before[1:], raw, own))
            before = None if ghost else (part, ident, raw, own)
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)


def range_of(key: Column, bounds: list[Column]) -> Column:
    """The last of `bounds` (sorted, few) that is at most the key, from 0; looks up two levels."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = F.greatest(at_most(F.array(*(g[0] for g in groups))), F.lit(1))
    fine = F.greatest(at_most(F.element_at(F.array(*(F.array(*g) for g in groups)), coarse)), F.lit(1))
    return (coarse - 1) * step + fine - 1


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row of `docs`: id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edited text's last floor(n_chars/2) code points are the first as many, or all, of
    the next text in ascending id; the last row's next is the first. Rows without id come
    first; equal ids are ordered by the XXH64 of their text, so that they are spread over
    ranges like others (only rows equal in id and text stay together). Ids may be of any
    type that sorts. Null text counts as empty (fingerprint '', likeness 1 to an empty one
    and 0 to others); very long texts are cut whole. An empty table gives an empty result;
    other columns are not read. `ranges` defaults to the session's shuffle partitions.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw")).withColumn("tie", F.xxhash64("raw"))
    key = F.struct("id", "tie")
    dealt = rows.select("id", "tie").repartitionByRange(ranges, F.col("id").asc_nulls_first(), "tie")  # keys only
    firsts = sorted(((r.least.id is not None, r.least.id, r.least.tie) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(key).alias("least")).collect()), key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
    bounds = [F.struct(F.lit(ident).cast(kind).alias("id"), F.lit(tie).alias("tie")) for _, ident, tie in firsts] or [F.struct(F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("tie"))]
    rows = rows.withColumn("part", range_of(key, bounds).cast("int"))
    lists = [F.array(*bounds[i : i + 100]) for i in range(0, len(bounds), 100)]
    bound = F.get(F.get(F.array(*lists), F.floor(F.col("part") / 100).cast("int")), F.col("part") % 100)
    ghost = F.when(bound == key, F.struct(F.pmod(F.col("part") - 1, F.lit(len(bounds))).alias("part"), F.lit(True).alias("ghost")))
    copies = F.filter(F.array(F.struct("part", F.lit(False).alias("ghost")), ghost), lambda x: x.isNotNull())
    rows = rows.select("id", "raw", "tie", F.inline(copies))
    dealt = rows.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("part", "ghost", F.col("id").asc_nulls_first(), "tie")
    return dealt.select("part", "ghost", "id", "raw").mapInArrow(
        compare_with_next, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumnRenamed("id", id_col)
