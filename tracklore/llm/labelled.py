"""What the classifiers share: held-out marks, bounded training samples, cached word rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_back, raw_text, staged

GRAINS = 1 << 20
SAMPLE_BYTES = 256 << 20  # of features that a fit takes at most; beyond it rows are left out by the hash of their order
REMEMBERED, AT_ONCE, ROWS = 1 << 17, 4096, 512


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves `part` on division by `parts`; a null id: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(order, label, raw) of about `most` labelled rows at most, and the shift for the true odds.

    Rows that are held out or lack an id or label never come in. Each class gives half of
    `most`, or all it has, chosen by a hash of the id; so the sample doesn't grow with the
    input and its ids can be broadcast. An id with several labels counts with the largest.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col, parts, part))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    rate = {k: min(1.0, most / 2 / n) for k, n in counts.items()}
    kept = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(GRAINS)) < F.when(F.col("label") == 1, rate.get(1, 0) * GRAINS).otherwise(rate.get(0, 0) * GRAINS)
    rows = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw")).join(F.broadcast(known.where(kept)), "id")
    return rows.select(F.xxhash64("id", "raw").alias("order"), "label", "raw"), float(np.log(rate.get(0, 1) / rate.get(1, 1)))


def trained(sample: DataFrame, features: Callable[[bytes], tuple], fit: Callable, most: int = SAMPLE_BYTES) -> tuple:
    """Fits a model on the bounded sample: features in many tasks, the fit in one, on at most about `most` bytes of features.

    `features(raw)` gives (ids, counts); `fit(list of (label, ids, counts))` gives float
    arrays, which are returned.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, max(1, whole.num_rows), ROWS)):
            made = [features(raw) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], names=["order", "label", "ids", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)) for b in batches for y, i, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        arrays = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(arrays)), pa.int32()), pa.array([np.asarray(a, np.float32).tobytes() for a in arrays], pa.binary())], names=["k", "data"])

    counted = staged(sample.mapInArrow(count, "order bigint, label int, ids binary, counts binary"))
    size = counted.agg(F.sum(F.length("ids") + F.length("counts"))).first()[0] or 0
    if size > most:
        counted = counted.where(F.pmod(F.xxhash64("order"), F.lit(GRAINS)) < F.lit(int(most / size * GRAINS)))
    model = counted.repartition(1).sortWithinPartitions("order", "label").mapInArrow(learn, "k int, data binary").collect()
    if not model:  # no labelled row
        return fit([])
    return tuple(np.frombuffer(bytes(r.data), np.float32) for r in sorted(model, key=lambda r: r.k))


def ngram_buckets(words: list[str], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of `<word>` and of every longer whole, for all words at once."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(word))
    h, found, owner = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, min(longest, len(codes)) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n >= shortest:
            inside = left[: len(h)] >= n
            x = (h[inside] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((x >> np.uint64(33)) % np.uint64(buckets))
            owner.append(word[: len(h)][inside])
    long = np.flatnonzero(sizes > longest)
    found.append(np.fromiter((xxhash.xxh32_intdigest(words[k]) % buckets for k in long), np.uint64, len(long)))
    owner.append(long)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


class WordRows:
    """A row of numbers per word, made `AT_ONCE` at a time when first asked for; forgets all beyond `REMEMBERED` words."""

    def __init__(self, width: int, make: Callable[[list], np.ndarray]):
        self.at: dict = {}
        self.rows, self.make = np.zeros((1024, width), np.float32), make

    def learn(self, words) -> None:
        """Makes the rows of the words that have none; call before `of`."""
        new = [w for w in words if w not in self.at]
        if not new:
            return
        if len(self.at) + len(new) > REMEMBERED:
            self.at.clear()
            new = list(words)
        start = len(self.at)
        while start + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            self.rows[start + i : start + i + len(part)] = self.make(part)
        self.at.update(zip(new, range(start, start + len(new)), strict=True))

    def of(self, words) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def in_blocks(texts: list, count: Callable, most: int = 100_000) -> Iterator[list]:
    """Blocks of `count(text)` results, a dict of words each, that hold about `most` words in all."""
    block, size = [], 0
    for raw in texts:
        words = count(raw)
        block.append(words)
        size += len(words)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def scored(docs: DataFrame, model, make_scorer: Callable, id_col: str, text_col: str, columns: str, keep: list[str] = ()) -> DataFrame:
    """id, `columns` and kept (a struct of the `keep` columns) per row.

    `make_scorer(model)` gives a function from a list of texts to tuples; tasks hand it
    `ROWS` texts at a time. A kept text goes through the tasks once, as the bytes that are scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    text_kind = docs.schema[text_col].dataType
    rest = F.struct(*(c for c in keep if c != text_col), F.col(text_col).isNull().alias("none__")).alias("rest")
    with_text = text_col in keep
    schema = f"id {kind}, {columns}, rest {docs.select(rest).schema[0].dataType.simpleString()}" + ", raw binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer(shared.value)
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, max(1, whole.num_rows), ROWS)):
            made = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)] + [batch.column(2)] + [batch.column(1)] * with_text, names=names)
        given_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    kinds, names = [f.type for f in fields[1 : len(fields) - 1 - with_text]], [f.name for f in fields]
    made = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw"), rest).mapInArrow(run, schema)
    own = lambda c: F.when(~F.col("rest.none__"), F.col("raw").cast("string").cast(text_kind)) if c == text_col else F.col("rest").getField(c)
    kept = F.struct(*(own(c).alias(c) for c in keep)) if keep else F.lit(None).cast("boolean")
    return made.withColumn("kept", kept).drop("rest", "raw")
