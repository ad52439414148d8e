"""Byte-level BPE with given ranks: encoding and decoding.

Encoding has three steps.

1. Tasks split their texts, once, into blocks: a block's distinct pieces with their counts,
   and each text as the numbers of its pieces in that block. Blocks are staged, compressed,
   and counts are summed per distinct piece.
2. The most frequent pieces (at most `FREQUENT`, of at most `SHORT` bytes) are encoded
   once each: a higher-order fold over the piece's bytes merges the neighbours with the
   lowest rank, found in a literal rank map, until none is left.
3. Tasks look a block's distinct pieces up in that table, which is broadcast and whose
   size is bounded by those two numbers. Other pieces are merged once a block, many at
   once, by functions that give the same ids, and remembered up to `REMEMBERED`. The ids
   of texts are then picked by number.

Moving each occurrence to a table of all distinct pieces and back would shuffle several
times the input; this way only the piece counts are shuffled.

Decoding joins the byte texts of the ids, which are a literal array, natively, and turns
the joined text into bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import AT_ONCE, given_back, raw_text, released, staged

FREQUENT, SHORT, REMEMBERED, BUCKETS, AT_ONCE_BYTES, BLOCK_BYTES = 1 << 18, 64, 1 << 17, 1024, 1 << 20, 1 << 24
BETWEEN = "\u0100"  # between byte texts, whose characters are below it


def read_ranks(path: str) -> list[bytes]:
    """The pieces in order of their rank, from a file of base64 pieces and ranks."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    pieces = [b""] * len(pairs)
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    return pieces


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: of all neighbouring pairs the one of lowest rank, leftmost first, is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        alive[after[i]] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


class Pairs:
    """Which id two neighbouring ids merge to, as sorted keys."""

    def __init__(self, pieces: list[bytes]):
        ranks = {p: i for i, p in enumerate(pieces)}
        found = [(a * len(pieces) + b, i) for i, p in enumerate(pieces) for k in range(1, len(p)) if (a := ranks.get(p[:k])) is not None and (b := ranks.get(p[k:])) is not None]
        self.n, self.none = len(pieces), np.int32(2**31 - 1)
        keys = np.array([k for k, _ in found] + [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, i in found] + [0], np.int32)[order]
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, `none` for those that don't; a negative id has no pair."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ids[at], self.none)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """`merge` of words of several bytes and similar length that have no rank as a whole, as int32 bytes: one merge of every word a step."""
        ends, out = np.cumsum([0, *map(len, words)]), [b""] * len(words)
        size = np.diff(ends)
        place = np.arange(size.max())
        inside = place < size[:, None]
        ids = np.full(inside.shape, -1, np.int32)
        ids[inside] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        rank, which = self.merged(ids[:, :-1], ids[:, 1:]), np.arange(len(words))
        while len(which):
            at, row = rank.argmin(1), np.arange(len(which))  # the first of the lowest
            best = rank[row, at]
            for k in np.flatnonzero(best == self.none).tolist():
                out[which[k]] = ids[k, : size[k]].tobytes()
            go = best != self.none
            ids, rank, size, which, at, best = ids[go], rank[go], size[go] - 1, which[go], at[go], best[go]
            if not len(which):
                break
            row, width = np.arange(len(which)), ids.shape[1] - 1
            ids = np.where(place[:width] > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[row, at] = best
            rank = np.where(place[: width - 1] > at[:, None], rank[:, 1:], rank[:, :-1]) if width > 1 else np.full((len(which), 1), self.none)
            after = ids[row, np.minimum(at + 1, width - 1)]
            has = at < width - 1
            rank[row[has], at[has]] = self.merged(best[has], after[has])
            has = at > 0
            rank[row[has], at[has] - 1] = self.merged(ids[row[has], at[has] - 1], best[has])
        return out


def byte_text(raw: bytes) -> str:
    """Bytes as a text of as many characters: a literal map of Spark can't have binary keys made by a function."""
    return raw.decode("iso-8859-1")


def split_literal(texts: list[str]) -> Column:
    """A literal array of byte texts."""
    return F.split(F.lit(BETWEEN.join(texts)), BETWEEN)


def rank_map(pieces: list[bytes]) -> Column:
    """A literal array of maps from a piece, as a byte text, to its rank; a piece is in the map that its hash names."""
    parts: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for rank, piece in enumerate(pieces):
        text = byte_text(piece)
        parts[xxhash.xxh64_intdigest(text.encode(), 42) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>")  # folded to one literal, so plans stay small


def merged_ids(word: Column, pieces: list[bytes]) -> Column:
    """Ids of a piece of text, by folding the ranked merges over the array of its bytes."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    text = F.decode(word.cast("binary"), "ISO-8859-1")
    start = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))

    def joined(p: Column, at: Column) -> Column:
        pair = F.array(F.concat(F.element_at(p, at), F.element_at(p, at + 1)))
        return F.concat(F.slice(p, F.lit(1), at - 1), pair, F.slice(p, at + 2, F.size(p)))

    def ids(table: Column) -> Column:
        rank = lambda x: F.try_element_at(F.element_at(table, (F.pmod(F.xxhash64(x), F.lit(BUCKETS)) + 1).cast("int")), x)

        def step(p: Column, _: Column) -> Column:
            ranks = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: rank(F.concat(F.element_at(p, i), F.element_at(p, i + 1))))
            best = lambda r: F.when(F.array_min(r).isNull(), p).otherwise(joined(p, F.array_position(r, F.array_min(r)).cast("int")))
            return F.when(F.size(p) < 2, p).otherwise(let(ranks, best))

        folded = F.when(F.length(text) < 2, start).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(text), F.lit(2))), start, step))
        return F.when(rank(text).isNotNull(), F.array(rank(text))).otherwise(F.transform(folded, rank))

    return let(rank_map(pieces), ids)  # named at each use, the map would stand in the plan, and in what the driver keeps of it, as often


def packed(rows: pa.Table, compression: str | None = None) -> bytes:
    """A table as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class Numbers(dict):
    """A number for each word, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def lists_of(ends: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), pa.int32()), pa.array(flat, pa.int32()))


def blocks_of(docs: DataFrame, id_col: str, text_col: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(words, texts), a row per block of some texts: packed tables of (word, n), and of (id, numbers) with places in the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, ids, texts, size = regex.compile(pattern).findall, Numbers(), [], [], 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(texts)
            words = pa.table({"word": pa.array(list(seen), pa.string()), "n": pa.array(np.bincount(flat, minlength=len(seen)), pa.int64())})
            rows = pa.table({"id": pa.chunked_array(ids), "numbers": lists_of(np.cumsum([0, *map(len, texts)]), flat)})
            return pa.RecordBatch.from_arrays([pa.array([packed(x, "zstd")], pa.binary()) for x in (words, rows)], names=["words", "texts"])

        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            begin = 0
            for i, raw in enumerate(batch.column(1).to_pylist(), 1):
                words = split(raw.decode("utf-8", "replace"))
                texts.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                size += len(raw)
                if i == batch.num_rows or size > block_bytes or len(seen) > FREQUENT:
                    ids.append(batch.column(0).slice(begin, i - begin))
                    begin = i
                if size > block_bytes or len(seen) > FREQUENT:
                    yield row()
                    seen, ids, texts, size = Numbers(), [], [], 0
        if texts:
            yield row()
        given_back()

    return staged(docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw")).mapInArrow(run, "words binary, texts binary"))


def piece_counts(blocks: DataFrame) -> DataFrame:
    """(word, n) summed over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield from unpacked(raw).to_batches()

    return blocks.select("words").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, whole counts only, at most `most`; they occur twice or more and are short."""
    counts = staged(counts.where((F.col("n") > 1) & (F.octet_length("word") <= SHORT)))
    grade = F.floor(F.log2("n") * 16)
    least, total = None, 0
    for g, n in sorted(map(tuple, counts.groupBy(grade.alias("g")).count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = g
    return counts.where(grade >= least) if least is not None else counts.limit(0)


class Words(dict):
    """Ids by word, as int32 bytes: the broadcast table, and what isn't in it merged when first asked for."""

    def __init__(self, table: dict[str, bytes], pieces: list[bytes], pairs: Pairs):
        super().__init__(table)
        self.ranks, self.pairs, self.rare = {p: i for i, p in enumerate(pieces)}, pairs, {}

    def prepare(self, texts: list[list[str]]) -> None:
        """Merges the short words of some texts that aren't known yet, those of similar length at once."""
        if len(self.rare) >= REMEMBERED:
            self.rare.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in set().union(*texts).difference(self.rare):
            if word not in self and 1 < len(raw := word.encode()) <= SHORT and raw not in self.ranks:
                by_size.setdefault(len(raw).bit_length(), []).append((word, raw))
        for bits, words in by_size.items():
            for some in (words[i : i + (AT_ONCE_BYTES >> bits)] for i in range(0, len(words), AT_ONCE_BYTES >> bits)):
                self.rare.update(zip((w for w, _ in some), self.pairs.merge_all([raw for _, raw in some]), strict=True))

    def __missing__(self, word: str) -> bytes:
        ids = self.rare.get(word)
        return np.array(merge(word.encode(), self.ranks), np.int32).tobytes() if ids is None else ids


def by_word(words: pa.Table) -> dict[str, bytes]:
    """The ids of each row's word as int32 bytes."""
    lists = words.column(1).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # as older versions give it
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    ends, flat = (lists.offsets.to_numpy() * 4).tolist(), lists.values.to_numpy().astype(np.int32).tobytes()
    return {w: flat[a:b] for w, a, b in zip(words.column(0).to_pylist(), ends, ends[1:], strict=False)}


def loaded(shared) -> Words:
    """A task's words; they go with the task, so that workers hold no more than one table."""
    pieces, pairs, words = shared.value
    return Words(by_word(unpacked(words)), pieces, pairs)


def ids_of_block(raw_words: bytes, raw_texts: bytes, table: Words) -> Iterator[pa.RecordBatch]:
    """(id, ids) of a block's texts, a few at a time: for all at once, what finds the ids would take many times the texts."""
    words, texts = unpacked(raw_words).column("word").to_pylist(), unpacked(raw_texts).combine_chunks()
    table.prepare([words])
    each = list(map(table.__getitem__, words))
    size, flat = np.fromiter(map(len, each), np.int64, len(each)) // 4, np.frombuffer(b"".join(each), np.int32)
    first = np.cumsum(size) - size  # of each piece's ids in `flat`
    for some in (texts.slice(i, AT_ONCE) for i in range(0, texts.num_rows, AT_ONCE)):
        lists = some.column("numbers").chunk(0)
        places, numbers = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        ends = np.cumsum(np.r_[0, size[numbers]])
        start = np.repeat(first[numbers] - ends[:-1], size[numbers])
        yield pa.RecordBatch.from_arrays([some.column("id").chunk(0), lists_of(ends[places - places[0]], flat[start + np.arange(len(start))])], names=["id", "ids"])


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, ids): the token ids of each whole text, in order; no special tokens.

    Null and empty texts have no ids; null or repeated ids keep their rows; an empty table
    gives an empty result; other columns are not read.
    """
    pieces, blocks = read_ranks(rank_path), blocks_of(docs, id_col, text_col, pattern)
    words = frequent_words(piece_counts(blocks), frequent).select("word", merged_ids(F.col("word"), pieces).alias("ids")).toArrow()
    released(docs)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, Pairs(pieces), packed(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(shared)
        for raw_words, raw_texts in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            yield from ids_of_block(raw_words, raw_texts, table)
        given_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return blocks.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(ids: Column, rank_path: str) -> Column:
    """The bytes that an array of ids stands for: the byte texts of its pieces, joined."""
    pieces = split_literal([byte_text(p) for p in read_ranks(rank_path)])
    return F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""), "ISO-8859-1")


def digests(tokens: DataFrame, rank_path: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of `tokens`: n_tokens, and SHA-256 of the ids joined by commas and of the decoded bytes."""
    ids = F.col("ids")
    return tokens.select(
        id_col,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded(ids, rank_path), 256).alias("decoded_sha256"),
    )
