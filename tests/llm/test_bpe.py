import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracklore.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    r = random.Random(1)
    odd = "\x00\t\n\r \x1c\x1f\x85\xa0 ᠎ ​ 　'sñßéÄ中文😀👩‍👧①Ⅷ٣_-<|endoftext|>"
    out = [None, "", " ", "\n\n  \n", "don't we'll I'M", "<|endoftext|>", "a" * 3000, " " * 500, "é" * 700, "12345" * 60, "!?" * 200, "ab" * 40]
    for n in (1, 3, 30, 300):
        out += ["".join(r.choice(odd + "abcdeth ing") for _ in range(n)) for _ in range(12)]
    words = ["the", "Thing", "queéa", "über", "ción", "x1", "..."]
    return out + [" ".join(r.choice(words) for _ in range(200)) for _ in range(5)]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 18])
def test_equals_the_library(spark, model, frequent):
    texts = samples()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the the", "x")], "doc_id long, text string, ids string")
    tokens = bpe.encode(docs, PATH, P.PATTERN, frequent=frequent)
    got = {r.doc_id: r for r in bpe.digests(tokens, PATH).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = model.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest(), t


def test_fold_equals_the_library(spark, model):
    r = random.Random(2)
    words = {w for w in ("".join(r.choice("etaoin shrdluéß中'") for _ in range(r.randint(1, 14))) for _ in range(300)) if w}
    words |= {"a", "é", " the", "internationalization"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for row in df.select("word", bpe.merged_ids(F.col("word"), bpe.read_ranks(PATH)).alias("ids")).collect():
        whole = model._encode_single_piece(row.word.encode())
        assert row.ids == whole and list(bpe.merge(row.word.encode(), {p: i for i, p in enumerate(bpe.read_ranks(PATH))})) == whole


def test_empty(spark):
    tokens = bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN)
    assert bpe.digests(tokens, PATH).collect() == []


def test_merging_at_once_equals_one_by_one(model):
    r = random.Random(4)
    pieces = bpe.read_ranks(PATH)
    words = {"".join(r.choice("etaoin shrdluéß中'xqz") for _ in range(r.randint(1, 30))) for _ in range(800)} | {"aaaaaaaaaaa", "éééééé", "zq"}
    words = [[w for w in words], ["ab" * 40, "x" * 3000, "q"]]
    table = bpe.Words({}, pieces, bpe.Pairs(pieces))
    table.prepare(words)
    assert len(table.rare) > 700
    for w in words[0] + words[1]:
        assert table[w] == b"".join(i.to_bytes(4, "little") for i in model._encode_single_piece(w.encode())), w


def test_texts_are_read_and_split_once(spark, model):
    reads = spark.sparkContext.accumulator(0)

    def seen(text: str) -> str:
        reads.add(1)
        return text

    texts = [x or "" for x in samples()]
    docs = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).select("doc_id", F.udf(seen)("text").alias("text"))
    blocks = bpe.blocks_of(docs, "doc_id", "text", P.PATTERN, block_bytes=100)
    assert blocks.count() > 10 and reads.value == len(texts)
    got = bpe.encode(docs, PATH, P.PATTERN, frequent=20).collect()
    assert reads.value == 2 * len(texts)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(((i if i % 5 else None, model.encode_ordinary(t)) for i, t in enumerate(texts)), key=key)


def test_the_rank_map_stands_once_in_the_plan(spark):
    """The driver keeps each plan's text; with a copy at each use, the pipeline's driver grew by as many texts of the map a run."""
    pieces = [bytes([b]) for b in range(256)] + [b"qz", b"qzx", b"jv"]
    found = spark.range(3).select(bpe.merged_ids(F.concat(F.lit("aqzx"), F.col("id").cast("string")), pieces).alias("ids"))
    assert found._jdf.queryExecution().executedPlan().toString().count("jv") == 1
    assert [r.ids for r in found.collect()] == [[97, 257, 48 + i] for i in range(3)]


def test_ids_of_a_block_come_a_few_texts_at_a_time():
    """What finds the ids of one block of 16 MB took some 120 MB of a worker."""
    r = np.random.default_rng(1)
    pieces = [bytes([b]) for b in range(256)]
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijkl"]
    numbers = r.integers(0, len(words), 1_000_000)
    ends = np.r_[0, np.sort(r.integers(0, len(numbers), 3_999)), len(numbers)]
    block = [bpe.packed(pa.table(x)) for x in ({"word": words}, {"id": range(4_000), "numbers": bpe.lists_of(ends, numbers)})]
    table = bpe.Words({}, pieces, bpe.Pairs(pieces))
    tracemalloc.start()
    found = [(i, hashlib.md5(np.array(ids, np.int32)).digest()) for some in bpe.ids_of_block(*block, table) for i, ids in zip(*(c.to_pylist() for c in some.columns), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    codes = np.array([list(w.encode()) for w in words], np.int32)[numbers]
    assert found == [(i, hashlib.md5(codes[a:b].tobytes()).digest()) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
    assert peak < 16 << 20
