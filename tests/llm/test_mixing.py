import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.llm import mixing


def cells(spark):
    r = random.Random(1)
    rows = [(s, x, t, r.randint(50, 5000)) for s in "abcd" for x in ("en", "de", "fr") for t in ("u", "v") if (s, x) != ("a", "fr")]
    return rows, spark.createDataFrame([*rows, ("z", "en", "u", 0)], "source string, lang string, topic string, tokens long")


def test_raking_meets_the_marginals_and_equals_numpy(spark):
    rows, df = cells(spark)
    targets = {"source": {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4, "unseen": 5.0}, "lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "topic": {"u": 0.5, "v": 0.5}}
    frames = {d: spark.createDataFrame(list(t.items()), "value string, share double") for d, t in targets.items()}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.raked(df, frames).collect()}
    w = {x[:3]: float(x[3]) for x in rows}
    for _ in range(200):
        for k, (d, t) in enumerate(targets.items()):
            known = {x[k] for x in w}
            all_ = sum(v for x, v in t.items() if x in known)
            sums = {v: sum(n for x, n in w.items() if x[k] == v) for v in known}
            w = {x: n * t[x[k]] / all_ / sums[x[k]] for x, n in w.items()}
    assert set(got) == set(w) and all(got[k] == pytest.approx(w[k], rel=1e-6) for k in w)


@pytest.mark.parametrize("budget", [0.05, 0.5, 0.9, 1.0])
def test_probabilities_meet_the_budget(spark, budget):
    _, df = cells(spark)
    weighted = mixing.raked(df, {d: mixing.tempered(df, d, 0.3) for d in mixing.DIMENSIONS})
    got = mixing.probabilities(weighted, budget).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(budget * sum(r.tokens for r in got), rel=1e-6)
    assert max(r.probability for r in got) <= 1
    free = [r.probability * r.tokens / r.weight for r in got if r.probability < 1]
    assert not free or max(free) == pytest.approx(min(free))


def test_sample_follows_probabilities_and_edges(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), r.choice(["en", "en", "de", None]), r.choice(["s1", "s1", "s1", "s2", None]), 9) for i in range(4000)]
    rows += [(None, "null id", "en", "s1", 9), (5000, None, "en", "s1", 9), (5001, "", "en", "s2", 9), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight int")
    got = mixing.mixed(docs, {"source": 0.5, "lang": 0.5, "topic": 1.0}, 0.5).collect()
    total = sum(len((x[1] or "").split()) for x in rows)
    assert sum(x.tokens for x in got) == pytest.approx(0.5 * total, rel=0.05)
    assert {5000, 5001}.isdisjoint({x.doc_id for x in got})
    again = mixing.mixed(docs.repartition(7), {"source": 0.5, "lang": 0.5, "topic": 1.0}, 0.5).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    shares = {s: sum(x.tokens for x in got if x.source == s) for s in ("s1", "s2", "")}
    roots = {s: sum(len((x[1] or "").split()) for x in rows if (x[3] or "") == s) ** 0.5 for s in shares}
    for s in shares:
        assert shares[s] / sum(shares.values()) == pytest.approx(roots[s] / sum(roots.values()), abs=0.03)
    assert mixing.mixed(docs.limit(0), {"source": 0.5}, 0.5).collect() == []
    assert np.isclose(spark.range(20000).select(mixing.unit_hash(__import__("pyspark.sql.functions").sql.functions.col("id")).alias("u")).agg({"u": "avg"}).first()[0], 0.5, atol=0.01)


def test_a_topic_splits_its_text_once(spark):
    df = spark.createDataFrame([("a b",)], "text string").select(mixing.topic_of(F.col("text"), ["a", "b"]).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(lower(") == 1


def test_plans_of_targets_stay_small(spark, monkeypatch):
    plans, staged = [], mixing.staged

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return staged(df)

    cells = spark.createDataFrame([(s, lang, t, 1 + 7 * len(s) + 3 * len(t)) for s in ("a", "bb") for lang in ("x", "y") for t in ("p", "qq")], "source string, lang string, topic string, tokens long")
    tables = {d: mixing.tempered(cells, d, 0.7) for d in mixing.DIMENSIONS}
    monkeypatch.setattr(mixing, "staged", seen)
    mixing.raked(cells, tables, rounds=0).collect()
    assert max(plans) < 45  # more when each dimension's plan held those before it twice


def test_a_dimension_joins_its_targets_once(spark, monkeypatch):
    plans, staged = [], mixing.staged

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return staged(df)

    cells = spark.createDataFrame([(s, lang, t, 1 + len(s)) for s in ("a", "bb") for lang in ("x", "y") for t in ("p", "qq")], "source string, lang string, topic string, tokens long")
    tables = {d: mixing.tempered(cells, d, 0.7) for d in mixing.DIMENSIONS}
    monkeypatch.setattr(mixing, "staged", seen)
    assert mixing.raked(cells, tables).count() == 8
    assert max(plans) == 1  # three when the third dimension's plan held the joins before it
