import hashlib
import random
import zlib

import numpy as np

from tracklore.llm import gear, media


def test_gear_equals_its_definition_and_resists_shifts():
    r = random.Random(1)
    raw = r.randbytes(5000)
    h = gear.rolling(np.frombuffer(raw, np.uint8))
    for i in (0, 5, 31, 32, 4999):
        assert int(h[i]) == sum(int(gear.GEAR[raw[i - j]]) << j for j in range(min(i + 1, 32))) % (1 << 32)
    ends = gear.cuts(raw, 16, 64, 256)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes[:-1].min() >= 16 and sizes.max() <= 256
    moved = gear.cuts(b"xyz" + raw, 16, 64, 256)
    assert len({e + 3 for e in ends} & set(moved)) > 0.8 * len(ends)
    assert gear.cuts(b"", 16, 64, 256) == [] and gear.cuts(b"ab", 16, 64, 256) == [2]


def test_round_trip(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdefg é") for _ in range(60000))
    texts = [None, "", "a", "x" * 64, "y" * 65, long, long, long + "tail", "head" + long, "\0\0", "z" * 200000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", "c")], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: r for r in media.media_features(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "a")]:
        raw = (t or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert g.media_bytes == len(payload) + 44 and g.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest() and g.feature == media.feature(payload)


def test_shared_chunks_are_kept_once(spark):
    r = random.Random(4)
    body = "".join(r.choice("abcdefgh ") for _ in range(100000))
    docs = spark.createDataFrame([(1, body + "one"), (2, "two" + body)], "doc_id long, text string").repartition(2)
    listed = media.chunk_rows(docs, "text", "list")
    assert listed.select("digest").distinct().count() < 0.7 * listed.count()
    assert media.media_features(docs).count() == 2
    assert media.media_features(docs.limit(0)).collect() == []
