"""Real mixes on small cases."""

from pyspark.sql import functions as F

from tracklore.functions import intervals as iv
from tracklore.operators import realmix


def test_kinds_spans_paths_and_answers(spark):
    df = spark.createDataFrame([("music", [(3, 5), (5, 7), (9, 11)], "/data/a/b.wav", 'so: {"n": 3, "s": {"t": 1}} ok', 7.0, [0.1] * 4), ("dog", [], "/other/b.wav", "no {braces", None, [0.0] * 4), (None, None, "/database/x", None, 99.0, None)], f"k string, s {iv.SPANS}, p string, t string, v double, w array<double>")
    rows = df.select(
        realmix.kind_of(F.col("k")).alias("k"), realmix.spans_or_whole(F.col("s"), F.lit(50)).alias("s"), realmix.relative_path(F.col("p"), "/data").alias("p"), realmix.json_in(F.col("t"), "n int")["n"].alias("n"),
        realmix.bounded(F.col("v"), 8.0, 12.0).alias("v"), realmix.present(F.col("w")).alias("w"), realmix.remapped(F.col("k"), {"dog": "dog_bark"}).alias("r"),
    ).collect()
    assert [x.k for x in rows] == ["music", "sfx", "sfx"] and [x.r for x in rows] == ["music", "dog_bark", None]
    assert [[tuple(s) for s in x.s] for x in rows] == [[(3, 7), (9, 11)], [(0, 50)], [(0, 50)]]
    assert [x.p for x in rows] == ["a/b.wav", "/other/b.wav", "/database/x"] and [x.n for x in rows] == [3, None, None]
    assert [x.v for x in rows] == [8.0, None, 12.0] and [x.w for x in rows] == [True, False, False]


def test_files_are_of_the_category_and_repeatable(spark):
    files = spark.createDataFrame([("dog", f"d{i}") for i in range(5)] + [("cat", "c0")], "category string, path string")
    asked = spark.createDataFrame([(i, ["dog", "cat", "cow", None][i % 4]) for i in range(200)], "k int, category string")
    got = {x.k: x.path for x in realmix.chosen_files(asked, files, "k", "category", "path", "s").collect()}
    assert len(got) == 200 and {got[k] for k in range(0, 200, 4)} == {f"d{i}" for i in range(5)}
    assert {got[k] for k in range(1, 200, 4)} == {"c0"} and {got[k] for k in range(200) if k % 4 > 1} == {None}
    assert got == {x.k: x.path for x in realmix.chosen_files(asked.repartition(7), files.repartition(3), "k", "category", "path", "s").collect()}


def test_captioners_that_fail_dont_end_the_job(spark):
    def make():
        def caption(rows):
            if (rows.k % 5 == 3).any():
                raise ValueError("no sound")
            return [f"clip {k}" for k in rows.k]

        return caption

    got = {x.k: (x.raw_text, x.error) for x in realmix.captioned(spark.range(20).withColumnRenamed("id", "k"), make).collect()}
    assert got == {k: (None, "ValueError: no sound") if k % 5 == 3 else (f"clip {k}", None) for k in range(20)}
