import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from tracklore.llm import mixing, simhash

DATA = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = (set(simhash.shingles(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_copies_against_brute_force(spark):
    r = random.Random(4)
    words = [f"wort{i}" for i in range(900)]
    groups = []
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randint(60, 400))]
        group = [" ".join(t)]
        for _ in range(r.choice([0, 1, 6])):
            u = list(t)
            for _ in range(max(1, len(u) // 120)):
                u[r.randrange(len(u))] = f"new{r.randrange(10**6)}"
            group.append(" ".join(u))
        groups.append(group + group[:1])
    big = [r.choice(words) for _ in range(300)]
    groups.append([" ".join([*big[:k], f"x{k}", *big[k + 1 :]]) for k in range(150)])  # near copies by the hundred
    half = [r.choice(words) for _ in range(200)]
    groups += [[" ".join(half)], [" ".join(half[:150] + [r.choice(words) for _ in range(50)])]]  # 0.6 alike: not copies
    rows = [(t, g) for g, group in enumerate(groups) for t in group]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, g, "k") for i, (t, g) in enumerate(rows)], "doc_id long, text string, g int, key string")
    got = simhash.one_of_each(docs).collect()
    assert docs.columns == got[0].__fields__
    firsts = {}
    for i, (_, g) in enumerate(rows):
        firsts.setdefault(g, i)
    assert {x.doc_id for x in got} == set(firsts.values()) and len(got) == len(groups)


def grouped(texts):
    """The smallest index of each text's group by brute force over real shingles."""
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if len(x & y) >= 0.8 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def test_copies_with_block_edits_equal_brute_force(spark):
    r = random.Random(9)
    words = [f"wort{i}" for i in range(900)]
    draw = lambda k: [r.choice(words) for _ in range(k)]
    line = draw(40)
    made = [[], ["a"], draw(3), draw(5)]
    for _ in range(60):
        t = draw(r.randint(30, 300))
        n = len(t)
        made += [t, t[: n - n // 10] + draw(n // 10), t + draw(n // 5), t[n // 8 :], draw(n // 9) + t]
        made.append(sum((t[i : i + 10][::-1] for i in range(0, n, 10)), []))  # the same words in another order
    made += [line + draw(k % 12) for k in range(80)]  # a line that many texts hold and little else
    texts = [" ".join(t) for t in made] + [" ", "\n"]
    r.shuffle(texts)
    got = {x.doc_id: x.first_id for x in simhash.copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = grouped(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < 0.7 * len(texts)


def test_copies_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (None, "lone words here"), (3, None), (4, ""), (5, "x y")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, "lone words here"), (1, "a b c"), (3, ""), (5, "x y")]
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, k):
    name, stage = cp.STAGES[k]
    text = "The cat and the dog were here, and the garden of the house was green in the spring of that year. "
    rows = [(i, text + f"Number {i} of them " * (i % 3), "en", f"s{i % 2}", 9, i, "x", "y") for i in range(12)]
    rows += [(None, text, None, None, None, None, None, None), (50, None, "en", "s1", None, 1, "x", "y"), (51, "", None, "s1", 0, 1, "x", "y"), (3, *rows[3][1:]), (60, "12 ½ !?", "en", "s1", 7, 1, "x", "y"), (61, text * 2000, "en", "s0", 1, 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, raw string, kept string")
    got = stage(spark, docs, DATA).collect()
    assert stage(spark, docs.limit(0), DATA).collect() == []
    if k == 4:
        assert len(got) == len(rows)
        assert {r.n_tokens for r in got if r.doc_id in (50, 51)} == {0}
        return
    assert all(r.__fields__ == docs.columns for r in got) and len(got) <= len(rows)
    ids = [r.doc_id for r in got]
    if name == "language ID":
        assert {50, 51, 60}.isdisjoint(ids) and None in ids and ids.count(3) == 2
    if k == 2:
        assert ids.count(0) == 1 and 3 not in ids and len({50, 51}.intersection(ids)) == 1
    if k == 3:
        assert {50, 51}.isdisjoint(ids)


def test_run_equals_its_stages(spark, steps):
    got = sorted(map(tuple, cp.run(spark, DATA).collect()))
    assert got == sorted(map(tuple, steps[5].collect()))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    made = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, made[-1], DATA).write.parquet(path)
        made.append(spark.read.parquet(path))
    return made


def test_stages_keep_columns_and_rows(steps):
    for before, after in zip(steps, steps[1:-1], strict=False):
        assert after.columns == steps[0].columns
        assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()
    assert steps[1].count() >= 0.98 * steps[0].count()
    assert steps[5].count() == steps[4].count()


def test_no_near_copies_stay_and_nothing_else_goes(steps):
    before, after = ({r.doc_id: r.text for r in steps[k].collect()} for k in (2, 3))
    kept = sorted(after)
    pairs = [(a, b) for a in kept for b in kept if a < b and jaccard(after[a], after[b]) >= 0.8]
    assert len(pairs) <= 0.02 * len(kept)
    for gone in set(before) - set(after):
        assert max(jaccard(before[gone], t) for i, t in before.items() if i != gone) >= 0.8


def test_mix_and_tokens(steps):
    total, kept = (steps[k].agg(F.sum(mixing.token_count(F.col("text")))).first()[0] for k in (3, 4))
    assert 0.6 * total < kept < 0.95 * total
    for r in steps[5].join(steps[4].select("doc_id", F.sha2("text", 256).alias("want")), "doc_id").collect():
        assert r.decoded_sha256 == r.want and r.n_tokens > 0
