"""Interval functions against sets of tenths, and on very long arrays."""

import random

import pytest
from pyspark.sql import functions as F

from tracklore.functions import intervals as iv


def cover(spans):
    return [t for a, b in spans for t in range(a, b)]


@pytest.mark.parametrize("least", [1, 0, -2])
def test_merged_equals_a_fold(spark, least):
    r, rows = random.Random(least + 5), []
    for k in range(120):
        rows.append((k, [(a, a + r.randint(least, 6)) for a in (r.randint(0, 30) for _ in range(r.randint(0, 7)))] if k else None))
    df = spark.createDataFrame(rows, f"k int, spans {iv.SPANS}")
    for gap in (0, 1, 3):
        for row in df.select("spans", iv.merged(F.col("spans"), gap).alias("m")).collect():
            want: list[list[int]] = []
            for a, b in sorted(map(tuple, row.spans or [])):
                if want and a - want[-1][1] < gap:
                    want[-1][1] = max(want[-1][1], b)
                else:
                    want.append([a, b])
            assert [list(x) for x in row.m] == want, (row.spans, gap)


def test_common_covered_and_overlap_equal_sets(spark):
    r, rows = random.Random(4), []
    for k in range(150):
        some = lambda: [(a, a + r.randint(1, 9)) for a in (r.randint(0, 40) for _ in range(r.randint(0, 5)))]
        rows.append((k, some(), some(), [some() for _ in range(r.randint(0, 4))]))
    df = spark.createDataFrame(rows, f"k int, a {iv.SPANS}, b {iv.SPANS}, many array<{iv.SPANS}>")
    got = df.select("*", iv.common(iv.merged(F.col("a")), iv.merged(F.col("b"))).alias("c"), iv.overlap_ratio(F.col("many"), F.lit(60)).alias("o"), *(iv.covered(F.col("a"), n).alias(f"n{n}") for n in (1, 2, 3))).collect()
    for x in got:
        assert x.c == len(set(cover(x.a)) & set(cover(x.b)))
        times = [t for s in x.many for t in set(cover(s))]
        assert x.o == pytest.approx(sum(times.count(t) > 1 for t in set(times)) / 60, abs=1e-6)
        all_ = cover(x.a)
        assert [x.n1, x.n2, x.n3] == [sum(all_.count(t) >= n for t in set(all_)) for n in (1, 2, 3)]


def test_runs_of_masks(spark):
    r = random.Random(6)
    masks = [[r.random() < 0.5 for _ in range(r.randint(0, 12))] for _ in range(60)]
    for x in spark.createDataFrame([(m,) for m in masks], "m array<boolean>").select("m", iv.runs(F.col("m")).alias("s")).collect():
        assert [t for a, b in x.s for t in range(a, b)] == [i for i, v in enumerate(x.m) if v]
        assert all(a[1] < b[0] for a, b in zip(x.s, x.s[1:]))


def test_a_hundred_thousand_spans_in_a_row(spark):
    spans = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: iv.span(i * 10 + i % 7, i * 10 + i % 7 + 6))
    df = spark.range(1).select(F.transform(spans, lambda s: s).alias("s")).cache()
    df.count()
    got = df.select(F.size(iv.merged(F.col("s"))).alias("n"), iv.overlap_ratio(F.array("s", "s"), F.lit(1_000_000)).alias("o"), iv.common(F.col("s"), iv.merged(F.col("s"))).alias("c"), F.size(iv.runs(F.transform("s", lambda x: x["start_ds"] % 2 == 0))).alias("r")).first()  # a copy of the array at each step would take hours
    assert got.n == 100_000 and got.c == 600_000 and got.o == 0.6
