import zlib
from collections import Counter

import numpy as np
import pytest

from tracklore.llm import labelled, langid, quality, toxicity

DATA = "/root/testdata/sf0.01"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_kneser_ney_equals_a_plain_version():
    counts = Counter({"abab": 3, "abc": 2, "b": 5, "cab": 1, "ä": 2})
    model = langid.merged([type("R", (dict,), {"__getattr__": dict.get})(lang="x", n=n, **dict(zip(("grams", "p", "contexts", "weights"), (a.tobytes() for a in arrays), strict=True))) for n, arrays in enumerate(langid.kneser_ney(counts))])
    n_max = langid.ORDER
    grams = [Counter() for _ in range(n_max)]
    for w, c in counts.items():
        t = langid.START * (n_max - 1) + w + langid.END
        for i in range(n_max - 1, len(t)):
            for n in range(n_max):
                grams[n][t[i - n : i + 1]] += c
    levels = []
    for n in range(n_max):
        count = grams[n] if n == n_max - 1 else Counter(g[1:] for g in grams[n + 1])
        ones, twos = sum(v == 1 for v in count.values()), sum(v == 2 for v in count.values())
        levels.append((count, ones / (ones + 2 * twos) if ones and twos else 0.5))

    def p(history, ch, n):
        if n < 0:
            return 2.0**-16
        h = history[len(history) - n :] if n else ""
        count, d = levels[n]
        after = {g: v for g, v in count.items() if g[:-1] == h and len(g) == n + 1}
        if not after:
            return p(history, ch, n - 1)
        total = sum(after.values())
        return max(after.get(h + ch, 0) - d, 0) / total + sum(min(v, d) for v in after.values()) / total * p(history, ch, n - 1)

    for w in ("abab", "b", "bca", "zz", "ä", "cabz"):
        t = langid.START * (n_max - 1) + w + langid.END
        want = sum(np.log(p(t[:i], t[i], n_max - 1)) for i in range(n_max - 1, len(t)))
        assert langid.word_scores([w], model)[0, 0] == pytest.approx(want, rel=1e-5)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.languages(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(lang) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.accepted for r in got]) > 0.99


def test_languages_edges(spark):
    rows = [(i, "the cat and the dog are here", "en", "x") for i in range(20)] + [(i, "der Hund und die Katze sind da", "de", "x") for i in range(20, 40)]
    rows += [(None, None, None, "x"), (41, "", "en", "x"), (42, "12 !?", None, "x"), (None, "the dog", "en", "x"), (1, "die Katze", None, "x"), (43, "Жщюя ъэы " * 90, None, "x")]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, raw string"))
    by = Counter((r.lang_pred, r.accepted) for r in got.collect())
    assert sum(by.values()) == len(rows) and by["und", False] == 3
    assert {r.lang_pred for r in got.where("doc_id = 1").collect()} == {"en", "de"} and not got.where("doc_id = 43").first().accepted
    none = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.languages(none).collect()] == [("und", 0.0)]
    assert langid.languages(none.limit(0)).collect() == []


def test_quality_and_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in got if r.held_out and r.doc_id in truth]) > 0.93
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    clean = [r.predicted for r in got if r.held_out and r.doc_id in truth and not truth[r.doc_id].toxic]
    assert np.mean(clean) < 0.03


def test_toxicity_fit_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_DOCS", 1)
    r = np.random.default_rng(2)
    rows = [(int(k % 3 == 0), np.sort(r.choice(40, 12, replace=False)).astype(np.int32), None) for k in range(60)]
    weights, bias = toxicity.fit(rows)
    toxic, other = ([set(ids.tolist()) for y, ids, _ in rows if y == c] for c in (1, 0))
    ratio = {f: np.log((sum(f in d for d in toxic) + 1) / (len(toxic) + 2) / ((sum(f in d for d in other) + 1) / (len(other) + 2))) for f in range(40)}
    used = {f for f in ratio if abs(ratio[f]) >= toxicity.LEAST_RATIO}
    w, b, past, past_b = dict.fromkeys(used, 0.0), 0.0, dict.fromkeys(used, 1e-8), 1e-8
    for _ in range(toxicity.ROUNDS):
        off = [(1 / (1 + np.exp(-(sum(ratio[f] * w[f] for f in ids.tolist() if f in used) + b))) - y) / len(rows) for y, ids, _ in rows]
        slope = {f: sum(o * ratio[f] for o, (_, ids, _) in zip(off, rows, strict=True) if f in ids) + toxicity.PENALTY * w[f] for f in used}
        for f in used:
            past[f] += slope[f] ** 2
            w[f] -= toxicity.RATE * slope[f] / past[f] ** 0.5
        past_b += sum(off) ** 2
        b -= toxicity.RATE * sum(off) / past_b**0.5
    assert used and bias[0] == pytest.approx(b, rel=1e-4)
    assert all(weights[f] == pytest.approx(w[f] * ratio[f] if f in used else 0.0, rel=1e-4, abs=1e-6) for f in range(40))


def test_quality_fit_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 30)
    r = np.random.default_rng(3)
    rows = [(int(k % 2), np.sort(r.choice(30, 5, replace=False)).astype(np.int32), r.integers(1, 4, 5).astype(np.int32)) for k in range(25)]
    got, bias = quality.fit(rows)
    r = np.random.default_rng(7)
    v = r.uniform(-1 / quality.SIZE, 1 / quality.SIZE, (30, quality.SIZE)).tolist()
    out, b, done, dims = [[0.0] * quality.SIZE for _ in range(2)], [0.0, 0.0], 0, range(quality.SIZE)
    for _ in range(quality.EPOCHS):
        for k in r.permutation(len(rows)):
            y, ids, counts = rows[k]
            rate = quality.RATE * (1 - done / (quality.EPOCHS * len(rows)))
            done += 1
            share = [c / sum(counts.tolist()) for c in counts.tolist()]
            mean = [sum(s * v[i][d] for s, i in zip(share, ids, strict=True)) for d in dims]
            e = [np.exp(sum(out[c][d] * mean[d] for d in dims) + b[c]) for c in (0, 1)]
            off = [e[c] / sum(e) - (c == y) for c in (0, 1)]
            back = [off[0] * out[0][d] + off[1] * out[1][d] for d in dims]
            for c in (0, 1):
                out[c] = [out[c][d] - rate * off[c] * mean[d] for d in dims]
                b[c] -= rate * 0.1 * off[c]
            for s, i in zip(share, ids, strict=True):
                v[i] = [v[i][d] - rate * len(ids) ** 0.5 * s * back[d] for d in dims]
    want = [sum(v[i][d] * (out[1][d] - out[0][d]) for d in dims) for i in range(30)]
    assert got == pytest.approx(want, rel=1e-3, abs=1e-5) and bias[0] == pytest.approx(b[1] - b[0], rel=1e-3)


def test_und_where_no_letter_is(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100, "½ ②", None), (101, "Ⅷ ² 12", None), (102, "a", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "en"


def test_rare_languages_and_ties(spark):
    same = [(i, "uno dos tres", x) for i, x in ((0, "b"), (1, "a"), (3, "c"), (4, "a"))]  # equal models: the first language in order
    got = langid.languages(spark.createDataFrame([*same, (50, "uno tres", None)], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"a"}
    long = "der Hund und die Katze " * 20_000
    docs = spark.createDataFrame([(i, f"the cat and {i} dogs", "en") for i in range(40)] + [(1000, long, "de"), (1001, long, None)], "doc_id long, text string, lang string")
    assert crc(1000, 4) != 2 and {r.lang_pred for r in langid.languages(docs).where("doc_id >= 1000").collect()} == {"de"}


def test_fit_takes_a_bounded_number_of_bytes(spark):
    sample = spark.createDataFrame([(i, i % 2, bytes(100)) for i in range(400)], "order long, label int, raw binary")
    n = labelled.trained(sample, lambda raw: (raw, b""), lambda rows: (np.full(1, len(rows)),), most=20_000)[0][0]
    assert 100 < n < 300


def test_toxicity_learns_words_it_is_shown(spark):
    r = np.random.default_rng(1)
    base = ["garden", "river", "window", "paper", "music", "stone", "yellow", "winter"]
    rows = []
    for i in range(600):
        words = list(r.choice(base, 30))
        if i % 5 == 0:
            words[int(r.integers(30))] = str(r.choice(["grotzel", "blarfing"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], 0, x[2]) for x in rows], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert all(x.predicted == (x.doc_id % 5 == 0) for x in got if x.held_out)


@pytest.mark.parametrize("score", [lambda d, x: quality.quality_scores(d, x), lambda d, x: toxicity.toxicity_scores(d, x)])
def test_classifier_edges(spark, score):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "word " * 5000, "c"), (3, "a b", "c"), (3, "a b", "c")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (None, 1, 0), (2, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = score(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id is None for r in got) == 1
    assert [r.score for r in score(docs, labels.limit(0)).collect()] == [0.5] * 5
    assert score(docs.limit(0), labels).collect() == []


def test_word_rows_forget_but_stay_right(monkeypatch):
    monkeypatch.setattr(labelled, "REMEMBERED", 10)
    known = labelled.WordRows(1, lambda words: np.array([[len(w)] for w in words]))
    for k in range(50):
        words = ["x" * (1 + (k * j) % 17) for j in range(9)]
        known.learn(set(words))
        assert known.of(words)[:, 0].tolist() == [len(w) for w in words]
