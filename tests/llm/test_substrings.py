import hashlib
import random

import duckdb
import numpy as np
import pytest

from tracklore.llm import queries
from tracklore.llm import substrings as sub

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def plainly(rows, window) -> list[str]:
    """Every window against every smaller id."""
    words = [(ident, (text or "").encode().split()) for ident, text in rows]
    least = {}
    order = lambda x: (x is None, x or 0)
    for ident, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, order(ident)), order(ident))
    out = []
    for ident, w in words:
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < order(ident) for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((ident, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def result(df) -> list[str]:
    return sorted(repr(tuple(x)) for x in df.select(*COLUMNS).collect())


def made(seed: int, n: int = 150) -> list[tuple]:
    """Texts with shared passages at any place, copies, near copies, repeats inside, repeated and null ids."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "\x1f", "日本"]
    some = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [some(r.randint(8, 40)) for _ in range(5)] + [["a"] * 30]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            parts += some(r.randint(0, 25)) + p[r.randint(0, 6) :][: r.randint(3, 40)]
        rows.append((r.choice([i, i, i, r.randint(0, n), None]), r.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(30_000 + i, "z " * r.randint(9, 90) + "y " * r.randint(0, 30) + "ab cd " * r.randint(0, 40)) for i in range(6)]  # the same windows over and over
    rows += rows[:5] + [(10_000 + i, rows[0][1]) for i in range(20)] + [(20_000 + i, f"{rows[2][1]} end {i}") for i in range(20)]
    rows += [(1, None), (2, ""), (3, " \n "), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limit", "window"), [(2, 10), (6, 3), (sub.LIMIT, 10), (sub.LIMIT, 3)])
def test_equals_brute_force(spark, limit, window):
    rows = made(window)
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, words string, g int")
    assert result(sub.dedup_substrings(docs, window=window, limit=limit)) == plainly(rows, window)


def test_windows_of_fifty_words_and_a_very_long_text(spark):
    r = random.Random(9)
    some = lambda k: [f"t{r.randrange(30)}" for _ in range(k)]
    passage, long = some(60), some(40_000)
    rows = [(i, " ".join(some(r.randint(0, 80)) + passage[r.randint(0, 12) :] + some(r.randint(0, 80)))) for i in range(60)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:20_000] + ["cut"] + long[20_000:])), (99, " ".join(passage[:50])), (98, " ".join(passage[:49]))]
    rows += [(200 + i, "same " * (49 + i)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (5, sub.LIMIT):
        assert result(sub.dedup_substrings(docs, limit=limit)) == plainly(rows, 50)


def test_text_ids_kept_texts_and_empty_tables(spark):
    rows = [("b", "x1 x2 x3 x4 x5"), ("a", "y x1 x2 x3 x4")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {x.doc_id: bytes(x.kept) for x in sub.dedup_substrings(docs, window=4, keep_text=True).collect()}
    assert got == {"a": b"y x1 x2 x3 x4", "b": b"x5"}
    assert sub.dedup_substrings(docs.limit(0)).collect() == []


def test_all_copies_of_a_window_have_its_anchor():
    r = random.Random(3)
    words = [f"{r.randrange(9)}".encode() for _ in range(400)]
    runs = sub.runs_of([words, [b"before"] * 7 + words, [b"few"]], 10)
    covered = {t: [] for t in (0, 1)}
    for text, h, start, top, n in runs:
        covered[text] += [(start + i - 7 * text, h, start + top - 7 * text) for i in range(n)]
    assert [x[0] for x in covered[0]] == list(range(391))  # each window once
    assert covered[1][7:] == covered[0]
    values = np.array([5, 3, 3, 9, 1, 1, 2], np.uint64)
    assert sub.least_places(values, 3).tolist() == [1, 1, 4, 4, 4]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op11_substring_dedup']})").fetchall()
    assert sum(x[2] for x in want) > 0
    assert result(queries.queries()["op11_substring_dedup"](spark, sf)) == sorted(map(repr, want))
