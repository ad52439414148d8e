import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tracklore.llm import fim, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def plainly(ident, text) -> tuple:
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = sha(f"42:{'' if ident is None else ident}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return ident, len(tokens), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return ident, len(tokens), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return ident, len(tokens), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def rows_of(df) -> list[str]:
    return sorted(map(repr, map(tuple, df.select(*COLUMNS).collect())))


@pytest.mark.parametrize("values", [[], [1], [5], [1, 2, 3], [7, 8, 300, 301, 70_000], list(range(3, 5000, 7))])
def test_elias_fano_lists_give_every_value_back(values):
    stored = fim.elias_fano(np.array(values, np.int64))
    assert [fim.Boundaries(stored).end(i) for i in range(len(values) + 1)] == [0, *values]


def test_lists_are_short():
    r = random.Random(1)
    values = np.cumsum([r.randint(1, 12) for _ in range(10_000)])
    assert len(fim.elias_fano(values)) < 0.7 * len(values)


def test_equals_a_plain_version(spark):
    r = random.Random(2)
    words = ["a", "bé", "<P", "<S", "M>", "日本", " x", "\U0001f600"]
    made = lambda: "".join(r.choice(words) + r.choice([" ", "\t\n", "", "  \r\x0b\x0c"]) for _ in range(r.randint(0, 40)))
    rows = [(i, r.choice([None, "", " \n", "<M> here", made(), made(), made()])) for i in range(300)]
    rows += rows[:7] + [(None, "null id"), (None, "null id"), (None, None)] + [(1000 + i, "one text of many copies ") for i in range(90)]
    rows += [(5000, "very long " * 60_000)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, key string, n int")
    want = sorted(map(repr, (plainly(*x) for x in rows)))
    for share in (8, 256):
        assert rows_of(fim.fill_in_middle(docs, share=share)) == want
    kept = fim.fill_in_middle(docs, share=8, keep_output=True).collect()
    assert all(hashlib.sha256(x.output).hexdigest() == x.output_sha256 for x in kept)
    assert {x.form for x in kept} == {"plain", "spm", "psm"}


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("x", "some words here"), ("y", "others")], "doc_id string, text string")
    assert rows_of(fim.fill_in_middle(docs)) == sorted(repr(plainly(*x)) for x in (("x", "some words here"), ("y", "others")))
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op13_fill_in_middle']})").fetchall()
    assert rows_of(queries.queries()["op13_fill_in_middle"](spark, sf)) == sorted(map(repr, want))
