import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tracklore.llm import graph, simhash

M = (1 << 64) - 1


def brute(texts, width=3, most=2):
    prints = []
    for t in texts:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
        parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
        hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in range(len(texts))}


def texts():
    r = random.Random(3)
    words = [f"w{i}é" for i in range(60)] + ["A", "The", "x y"]
    out = [None, "", " \t\n", "One", "one", "Two words", "two  WORDS", "zwei Wörter ÄÖ"]
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randint(1, 400))]
        out += [" ".join(t)] * r.randint(1, 2)
        for _ in range(3):
            u = list(t)
            u[r.randrange(len(u))] = "changed"
            out.append("\n".join(u))
    return out


def test_groups_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute([t for _, t, _ in rows])


def test_links_with_large_buckets_equal_brute_force(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(220):  # near one value, so that whole keys are shared
        x = r.choice(sorted(prints))
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    prints |= {r.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for most in (0, 1, 2):
        got = {(x.a, x.b) for x in simhash.links(df, most).collect()}
        up = {x: x for x in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        pairs = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & M).bit_count() <= most}
        assert got <= {(min(p), max(p)) for p in got}
        assert all(((a ^ b) & M).bit_count() <= most for a, b in got)
        for a, b in got:
            up[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in pairs)


def test_empty_null_and_repeated(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "lone text here")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 4), (False, 4), (True, -1), (True, 4)]


def test_components_of_long_chain(spark):
    n = 200
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 500: 500, 501: 500}


def test_bit_majority():
    assert simhash.bit_majority(np.array([3, 1, 1 << 63], np.uint64)) == 1
    assert simhash.bit_majority(np.array([1 << 63], np.uint64)) == -(1 << 63)


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & M == xxhash.xxh64_intdigest(b"a b c", 42)


def test_plans_of_components_stay_small(spark, monkeypatch):
    plans, staged = [], graph.staged

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return staged(df)

    monkeypatch.setattr(graph, "staged", seen)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 10], "a long, b long")
    roots = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert roots == {i: 0 if i <= 10 else 11 for i in range(31)}
    assert len(plans) > 3 and max(plans) < 40  # 80 when a round was one plan


def test_plans_of_near_prints_stay_small(spark):
    profiles = spark.createDataFrame([(1, [5, 9]), (2, [4, 77]), (3, [(1 << 40) + (7 << 50), 11])], "uid long, fps array<long>")
    found = simhash.near_prints(profiles)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("\n") < 20  # 29 when the links were not staged
    assert {frozenset((r.a, r.b)) for r in found.collect()} == {frozenset((1, 2)), frozenset((1, 3))}


def test_groups_and_first_members_have_small_plans(spark):
    """The driver keeps the plan and metrics of each run, anew at each of its steps; the groups' last step stood in them as often as it was used."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    roots = graph.connected_components(edges)
    assert "Exchange" not in plan(roots) and sorted(map(tuple, roots.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y")], "doc_id long, text string")
    found = simhash.copies(docs)
    assert plan(found).count("Exchange") <= 3 and sorted((r[0], r[2]) for r in found.collect()) == [(1, 1), (2, 1), (3, 3)]
