"""Transcript and speaker errors against brute force."""

import itertools
import random

import pytest

from tracklore.functions import intervals as iv
from tracklore.operators import speech


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_and_character_errors(spark):
    r = random.Random(1)
    some = lambda: r.choice([None, "", "  "]) if r.random() < 0.15 else " ".join(r.choice(["a", "B", "é", "日本", "\U0001f600x", "word"]) for _ in range(r.randint(1, 9)))
    rows = [(i, some(), some()) for i in range(120)] + [(999, " ".join(f"w{i}" for i in range(600)), " ".join(f"w{i}" for i in range(5, 600)))]
    for x in speech.error_rates(spark.createDataFrame(rows, "k int, ref_text string, hyp_text string")).collect():
        a, b = (("" if t is None else t).lower().split() for t in (x.ref_text, x.hyp_text))
        assert (x.n_words, x.word_errors) == (len(a), distance(a, b))
        assert (x.n_chars, x.char_errors) == (len(" ".join(a)), distance(" ".join(a), " ".join(b)))
        assert x.wer == pytest.approx(x.word_errors / len(a) if a else float(bool(b)), abs=1e-6)


def test_speakers_are_paired_at_the_least_cost(spark):
    r = random.Random(2)
    said = lambda: " ".join(r.choice("abcdef") for _ in range(r.randint(0, 5)))
    refs = [(f"c{i % 8}", r.choice(["ann", "bob", "cy"]), i, said()) for i in range(60)]
    hyps = [(f"c{i % 9}", r.choice(["s1", "s2", "s3", "s4"]), i, said()) for i in range(60)]
    schema = "sample_id string, speaker string, pos int, text string"

    def joined(rows, clip):
        out = {}
        for c, s, _, t in rows:
            if c == clip:
                out.setdefault(s, []).extend(t.split())
        return list(out.values())

    got = {x.sample_id: x for x in speech.cpwer(spark.createDataFrame(refs, schema), spark.createDataFrame(hyps, schema)).collect()}
    assert sorted(got) == sorted({c for c, *_ in refs})
    for clip, x in got.items():
        a, b = joined(refs, clip), joined(hyps, clip)
        n = max(len(a), len(b))
        a, b = a + [[]] * (n - len(a)), b + [[]] * (n - len(b))
        best = min(sum(distance(u, v) for u, v in zip(a, p)) for p in itertools.permutations(b))
        assert (x.n_words, x.errors) == (sum(map(len, a)), best)


def test_speaker_time(spark):
    r = random.Random(3)
    turns = lambda names: [(f"c{i % 6}", r.choice(names), [(s, s + r.randint(1, 8)) for s in (r.randrange(40) for _ in range(r.randint(1, 3)))]) for i in range(40)]
    refs, hyps = turns(["a", "b", "c"]), turns(["x", "y"])
    schema = f"sample_id string, speaker string, spans {iv.SPANS}"

    def at(rows, clip):
        out = {}
        for c, s, spans in rows:
            if c == clip:
                out.setdefault(s, set()).update(t for p, q in spans for t in range(p, q))
        return out

    for x in speech.diarization(spark.createDataFrame(refs, schema), spark.createDataFrame(hyps, schema)).collect():
        a, b = at(refs, x.sample_id), at(hyps, x.sample_id)
        per = lambda who, t: sum(t in s for s in who.values())
        times = range(60)
        names = [*b, *[None] * len(a)]
        right = max(sum(len(a[u] & b[v]) for u, v in zip(a, p) if v) for p in itertools.permutations(names, len(a)))
        assert x.ref_ds == sum(map(len, a.values()))
        assert x.missed_ds == sum(max(0, per(a, t) - per(b, t)) for t in times)
        assert x.false_ds == sum(max(0, per(b, t) - per(a, t)) for t in times)
        assert x.confused_ds == sum(min(per(a, t), per(b, t)) for t in times) - right
        assert x.der == pytest.approx((x.missed_ds + x.false_ds + x.confused_ds) / x.ref_ds, abs=1e-6) and 0 <= x.jer <= 1
    same = spark.createDataFrame(refs, schema)
    assert {(x.der, x.jer) for x in speech.diarization(same, same).collect()} == {(0.0, 0.0)}
