"""Every query that SQL can express gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from tracklore.plans import registry

SMALLEST = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    """A value as text, floats to six digits, without the sign of zero."""
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value + 0.0:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return plain([value[k] for k in sorted(value)])
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return f"{float(value):.6g}" if hasattr(value, "as_tuple") else str(value)


def split(rows: list[list]) -> list[tuple[list[str], list[float]]]:
    """Each row's other values as text and its floats, in order."""
    floats = lambda r: [v for v in r if isinstance(v, float)]
    return sorted(([plain(v) if not isinstance(v, float) else "" for v in r], floats(r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALLEST):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALLEST}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALLEST)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = split([[r[names.index(c)] for c in columns] for r in cursor.fetchall()])
    got = split([[r[c] for c in columns] for r in df.collect()])
    assert [k for k, _ in got] == [k for k, _ in want]
    for (key, mine), (_, its) in zip(got, want, strict=True):
        assert mine == pytest.approx(its, rel=1e-6, abs=1.1e-6), key  # the sixth digit of a mean depends on the order of the sum


def test_queries_without_sql_have_rows(spark):
    if not os.path.isdir(SMALLEST):
        pytest.skip("no test tables")
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SMALLEST).count() > 0, name
