import hashlib
import random

from tracklore.llm import fingerprints as fp


def test_equals_one_pass_over_sorted_rows(spark):
    r = random.Random(1)
    words = [f"wörd{i}" for i in range(200)]
    rows = [(r.choice([None, *range(-30, 40)]), r.choice([None, "", "a", "ab", " ".join(r.choice(words) for _ in range(r.randint(1, 300)))]), 1) for _ in range(120)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    from pyspark.sql import functions as F

    ordered = [(x.doc_id, x.raw.decode()) for x in docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("raw")).collect()]
    want = []
    for i, (ident, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, e, b = (fp.chunk_weights(x.encode()) for x in (text, edited, after))
        want.append((ident is None, ident or 0, n, hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(a), fp.as_text(e), fp.containment(a, e), fp.containment(a, b)))
    for ranges in (1, 4, 50):
        got = [(x.doc_id is None, x.doc_id or 0, *x[1:]) for x in fp.fingerprint_edits(docs, ranges=ranges).collect()]
        assert sorted(got) == sorted(want)


def test_containment_and_edges(spark):
    r = random.Random(3)
    text = " ".join(f"{r.randrange(10**6)}" for _ in range(2000))
    a = fp.chunk_weights(text.encode())
    assert sum(a.values()) == len(text) and fp.containment(a, a) == 1
    assert fp.containment(a, fp.chunk_weights(("new start " + text).encode())) > 0.95
    assert 0.4 < fp.containment(a, fp.chunk_weights(text[: len(text) // 2].encode())) < 0.55
    assert fp.containment(a, {}) == 0 and fp.containment({}, {}) == 1 and fp.containment({}, a) == 0
    one = fp.fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_ids_and_a_very_long_text(spark):
    r = random.Random(4)
    long = " ".join(f"{r.randrange(10**6)}" for _ in range(60_000))
    rows = [("b", long), ("a", "x" * 50), (None, "y"), (None, "z"), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(x.doc_id, x.n_chars): x for x in fp.fingerprint_edits(docs, ranges=3).collect()}
    assert len(got) == 4 and got["b", len(long)].fingerprint == fp.as_text(fp.chunk_weights(long.encode()))
    assert got["a", 50].edited_sha256 == hashlib.sha256(("x" * 25 + long[:25]).encode()).hexdigest()
