import random
import re

from tracklore.llm import licenses as lic


def brute(text, templates, least=0.8):
    """Names of the templates of which enough shingles stand within their own length of some place, rivals left out by hand."""
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    found = set()
    for name, notice in templates:
        t = [w for w in re.split(r"[\W_]+", notice.lower()) if w]
        own = {" ".join(t[i : i + 3]) for i in range(len(t) - 2)}
        if any(len(own & set(parts[max(0, p - len(own)) : p + len(own)])) / len(own) >= least for p in range(len(parts))):
            found.add(name)
    return ",".join(sorted(found))


SOME = [n for n in lic.NOTICES if n[0] in ("MIT", "Apache-2.0", "CC-BY-SA-4.0", "MPL-2.0", "CC0-1.0")]


def test_equals_brute_force(spark):
    r = random.Random(1)
    words = [f"wort{i}" for i in range(300)] + ["licensed", "under", "the", "License"]
    texts = [None, "", "MIT", " ".join(f"w{r.randrange(500)}" for _ in range(60_000)) + " released under the MIT license", "Released under the", "Released### under%%% the&&& MIT%%% License!!", "RELEASED UNDER THE MIT LICENSE"]
    for _ in range(60):
        t = [r.choice(words) for _ in range(r.choice([0, 5, 40, 400, 3000]))]
        for _, notice in r.sample(SOME, r.randint(0, 2)):
            n = notice.split()
            if r.random() < 0.4:
                n[r.randrange(len(n))] = "other"
            k = r.randint(0, len(t))
            t[k:k] = n
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "Released under the MIT License.", "x")], "doc_id long, text string, matches string")
    got = {r.doc_id: r for r in lic.licenses(docs, templates=SOME).collect()}
    assert len(got) == len(texts) + 1 and got[None].licenses == "MIT"
    for i, t in enumerate(texts):
        assert got[i].licenses == brute(t, SOME), t
        assert got[i].n_licenses == len(got[i].matches)
    assert sum(bool(brute(t, SOME)) for t in texts) > 25
    assert lic.licenses(docs.limit(0)).collect() == []


def test_bands():
    assert 1 - (1 - 0.3) ** lic.bands_for(0.3, 0.999) >= 0.999 > 1 - (1 - 0.3) ** (lic.bands_for(0.3, 0.999) - 1)


def test_whole_texts_and_their_variants(spark):
    r = random.Random(7)
    noise = lambda k: " ".join(f"n{r.randrange(10**5)}" for _ in range(k))
    cases = []
    for name, text in lic.TEXTS:
        cases.append((name, f"Copyright (c) someone. {text}"))
        cases.append((name, noise(r.randint(0, 50)) + " " + text.replace(", ", ",\n * ").upper() + " " + noise(200)))
    two = dict(lic.TEXTS)
    cases += [("", noise(500)), ("", two["MIT"][:300]), ("ISC,Zlib", two["Zlib"] + noise(300) + " " + two["ISC"]), ("MIT", "Licensed under the MIT license. " + two["MIT"])]
    got = {x.doc_id: x.licenses for x in lic.licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_band_hashes_are_those_of_the_session(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.xxhash64(F.lit(-12345).cast("bigint"), F.lit(3).cast("bigint")).alias("h")).first()
    assert row.h == lic.banded(-12345, 3)
