import random
import re
from collections import Counter

import duckdb
import pytest

from tracklore.llm import collocations as co
from tracklore.llm import queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, longest=5, top=2000) -> list[tuple]:
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in counts.items() if a >= least and len(k) > 2}
    dropped = set()
    for (lang, *longer), a in candidates.items():
        for n in range(2, len(longer)):
            dropped |= {(lang, *longer[i : i + n]) for i in range(len(longer) - n + 1) if a >= counts[(lang, *longer[i : i + n])]}
    out = {}
    for (lang, *words), a in candidates.items():
        if (lang, *words) not in dropped:
            cut = min((1000 * a * totals[lang] // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words)))
            l, r = counts[(lang, *words[: cut[1]])], counts[(lang, *words[cut[1] :])]
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), l, r, totals[lang]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, found in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top]))


def result(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(6)] + ["The", "É", "日本", "the"]
    hot = "a very common passage of words"
    made = lambda: "".join(r.choice([hot, r.choice(words), r.choice(words), "x"]) + r.choice([" ", " ", "\t", "  ", ". ", "\n", "\x0b", "\x1f"]) for _ in range(r.randint(0, 40)))
    out = [(r.choice(["en", "en", "en", "de", None]), r.choice([made(), made(), made(), "", None, "...", " \t "])) for _ in range(300)]
    return out + out[:9] + [("en", "x " * 3000), ("fr", "once upon a time")]


@pytest.mark.parametrize(("limit", "known"), [(20, 0), (20, co.KNOWN), (400, 0), (co.LIMIT, co.KNOWN)])
def test_equals_a_plain_version(spark, rows, limit, known, monkeypatch):
    monkeypatch.setattr(co, "KNOWN", known)  # words that rows bring, or that are broadcast
    docs = spark.createDataFrame([(lang, text, "clash", 3) for lang, text in rows], "lang string, text string, phrase string, n int")
    want = plainly(rows, 8)
    assert len(want) > 50
    assert result(co.collocations(docs, least=8, limit=limit)) == want


def test_blocks_and_flushes_lose_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(co, "BLOCK", 50)  # in the driver; tasks that run here don't see it, so the parts are tried directly
    text = "aa bb, cc. " * 20 + "no end " * 30
    assert b"".join(co.blocks(text.encode())) == text.encode().translate(co.PLAIN) and len(list(co.blocks(text.encode()))) > 3
    assert result(co.collocations(docs, least=8, longest=3, top=4)) == plainly(rows, 8, 3, 4)


def test_parts_of_pointers_can_be_packed_and_merged():
    import numpy as np

    r = np.random.default_rng(2)
    pointers = r.integers(0, 5, (400, 5)).astype(np.int32)
    rows, counts = co.merged(pointers, np.ones(400, np.int64))
    assert sorted(zip(map(tuple, rows.tolist()), counts.tolist())) == sorted(Counter(map(tuple, pointers.tolist())).items())
    words = [b"", b"a", "é".encode(), b"c", b"d"]
    names, again, n = co.unpacked(*co.packed(words, rows, counts))
    assert [[names[i] for i in x] for x in again.tolist()] == [[words[i] for i in x] for x in rows.tolist()] and (n == counts).all()
    names, again, n = co.unpacked(*co.packed(words, rows, counts, True), words)
    assert names is words and (again == rows).all() and (n == counts).all()
    full = rows[(rows > 0).all(axis=1)]
    names, again, _ = co.unpacked(*co.packed(words, full, counts[: len(full)]))
    assert [[names[i] for i in x] for x in again.tolist()] == [[words[i] for i in x] for x in full.tolist()]


def test_large_numbers_and_ties(spark):
    rows = [("en", "b c. a b. ") for _ in range(100)] + [("en", "p q r. ")] * 120
    assert result(co.collocations(spark.createDataFrame(rows, "lang string, text string"))) == plainly(rows, 100)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert result(co.collocations(docs)) == []
    assert result(co.collocations(spark.createDataFrame([("en", "too few words")], "lang string, text string"))) == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_phrase_collocations']})").fetchall()
    assert result(queries.queries()["op12_phrase_collocations"](spark, sf)) == sorted(want)
