"""Media columns kept as content-defined chunks.

A text's payload is kept as a WAV file of 8-bit samples. The file is cut by a gear hash;
chunks that occur in several files are kept once, under their digest. Reading joins each
file's ordered chunk list with the chunks, rebuilds the file, verifies it and computes
features from its samples.

Movement of bytes: a chunk that only one file has travels once, to the file's partition.
Which chunks are shared is found on digests alone; a bit set of fixed size tells the tasks
(a chunk marked by chance takes the shared path, which is right for it too). Shared chunks
are joined by digest; the join's two sides are plain shuffles, so a chunk that very many
files share can be split by adaptive execution.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, staged
from .gear import cuts

LEAST, NORMAL, MOST, RATE = 2048, 8192, 32768, 8000
MARKS = 1 << 24  # bits of the set that marks shared chunks: 2 MB
SEEN = 1 << 20  # texts that a task remembers, so as not to send copies


def wav(payload: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file that `wav` made; ValueError if it isn't one."""
    head = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if head[0] != b"RIFF" or head[2] != b"WAVE" or head[10] != 8 or head[12] != len(media) - 44:
        raise ValueError("not a WAV file of 8-bit samples")
    return media[44:]


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def feature(payload: bytes) -> str:
    """Mean, deviation and peak around the middle, crossings of it, and shares of eight ranges."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    spread = np.bincount((x + 128) >> 5, minlength=8) / len(x)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return ";".join([f"mean={x.mean():.6f}", f"dev={x.std():.6f}", f"peak={int(np.abs(x).max())}", f"crossings={crossings}", "ranges=" + ",".join(f"{v:.6f}" for v in spread)])


def position(digest: bytes) -> int:
    return xxhash.xxh64_intdigest(digest, 42) % MARKS  # as Spark's xxhash64


def chunk_rows(docs: DataFrame, text: str, kind: str, marks=None) -> DataFrame:
    """(key, seq, digest, size, bytes) of the chunks of each text; a task sends equal texts once.

    kind `list`: all, without bytes; `own`: those not marked, with bytes; `refs`: those
    marked, without; `store`: those marked, with bytes and once per digest and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if marks is None else np.frombuffer(marks.value, np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(0).to_pylist():
                key = hashlib.sha256(raw).digest()
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                media, start = wav(payload_of(raw)), 0
                for seq, end in enumerate(cuts(media, LEAST, NORMAL, MOST)):
                    part, start = media[start:end], end
                    digest = hashlib.blake2b(part, digest_size=16).digest()
                    if bits is not None:
                        at = position(digest)
                        if bool(bits[at >> 3] >> (at & 7) & 1) == (kind == "own"):
                            continue
                    if kind == "store":
                        if digest in seen:
                            continue
                        seen.add(digest)
                    out.append((key, seq, digest, len(raw), zlib.compress(part, 6) if kind in ("own", "store") else None))
                if len(out) >= 2000:
                    yield rows(out)
                    out = []
            yield rows(out)

    return docs.select(raw_text(text).alias("raw")).mapInArrow(run, "key binary, seq int, digest binary, size bigint, bytes binary")


def rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["key", "seq", "digest", "size", "bytes"])


def shared_marks(listed: DataFrame) -> bytes:
    """The bit set of digests that occur at two places or more; `MARKS` bits whatever the input."""
    ends = listed.groupBy("digest").agg(F.min(F.struct("key", "seq")).alias("a"), F.max(F.struct("key", "seq")).alias("b")).where("a <> b")
    words = ends.select(F.pmod(F.xxhash64("digest"), F.lit(MARKS)).alias("at")).groupBy(F.expr("at div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits")).toArrow()
    marks = np.zeros(MARKS // 32, np.uint32)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return marks.tobytes()


def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks sorted by (key, seq): each file rebuilt, verified, read back and measured."""
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    key, size, parts, last = None, 0, [], -1

    def measured() -> tuple:
        media = b"".join(parts)
        payload = samples(media)
        if hashlib.sha256(payload[:size]).digest() != key:
            raise ValueError("a rebuilt file isn't the one that was kept")
        return (key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        out: list[tuple] = []
        for k, seq, n, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                if key is not None:
                    out.append(measured())
                key, size, parts, last = k, n, [], -1
            if seq != last:  # equal texts come from several tasks
                parts.append(zlib.decompress(part))
                last = seq
        yield batch_of(out)
    if key is not None:
        yield batch_of([measured()])


def stored_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per distinct text: its key (SHA-256) and what was measured on the file read back."""
    context = docs.sparkSession.sparkContext
    marks = context.broadcast(shared_marks(chunk_rows(docs, text_col, "list")))
    store = chunk_rows(docs, text_col, "store", marks).groupBy("digest").agg(F.first("bytes").alias("bytes"))
    refs = chunk_rows(docs, text_col, "refs", marks).select("key", "seq", "size", "digest")
    joined = refs.join(staged(store), "digest").select("key", "seq", "size", "bytes")
    chunks = chunk_rows(docs, text_col, "own", marks).select("key", "seq", "size", "bytes").union(joined)
    return chunks.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(
        rebuild, "key binary, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, sizes, digests and features of its stored media.

    Null text counts as empty: its payload is 64 zero bytes. Equal texts share one stored
    file. Null or repeated ids keep their rows; an empty table gives an empty result;
    other columns are not read. A file that isn't rebuilt exactly fails the job.
    """
    files = stored_media(docs, text_col)
    keyed = docs.select(F.col(id_col), F.unhex(F.sha2(raw_text(text_col), 256)).alias("key"))
    return keyed.join(files, "key").drop("key")
