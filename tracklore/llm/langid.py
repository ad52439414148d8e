"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of order `ORDER` over the characters of
its words (letter runs in lower case, padded). The languages' n-grams are hashed into one
sorted array per order with a log probability per language; a second sorted array holds
the back-off weights of contexts. A text gets the language of the lowest cross-entropy per
character. Two numbers are calibrated on texts kept out of the models: a temperature, which
makes the score a probability, and per language the entropy beyond which a text is rejected.

Models are fitted per language on a sample of bounded size; scores of words are remembered
per task, so a text costs one lookup per distinct word.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text
from .labelled import GRAINS, WordRows, held_out, in_blocks, scored

ORDER, SAMPLE_BYTES, CALIBRATION = 4, 1_000_000, 8  # one sampled text in so many calibrates
FACTORS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(1, ORDER + 1)], np.uint64)
UNSEEN = np.log(2.0**-16)  # the uniform share below single characters
LETTERS = regex.compile(r"\p{L}+")  # letters by Unicode category; numerals such as ½ or Ⅷ are none
START, END = "\x02", "\x03"


def words_of(raw: bytes) -> Counter:
    return Counter(LETTERS.findall(raw.decode("utf-8", "replace").lower()))


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character of the padded words: the hashes of the n-grams that end there (one row
    per order), the hashes of their contexts, and the word it belongs to."""
    text = "".join(f"{START * (ORDER - 1)}{w}{END}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) + (word + 1) * (ORDER - 1)
    sums, grams, contexts = np.zeros(len(at), np.uint64), [], []
    for j in range(ORDER):
        if j:
            contexts.append(context)
        sums = sums + codes[at - j] * FACTORS[j]
        grams.append(sums)
        context = sums_of(codes, at - 1, j + 1) if j + 1 < ORDER else None
    return np.array(grams), np.array(contexts), word


def sums_of(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = total + codes[at - j] * FACTORS[j]
    return total


def kneser_ney(counts: Counter) -> list[tuple[np.ndarray, ...]]:
    """Per order, from word counts: (n-gram hashes, log probabilities, context hashes, log weights), sorted by hash.

    The highest order discounts occurrences, the lower ones the number of distinct
    characters before an n-gram; each interpolates with the order below.
    """
    words = list(counts)
    grams, contexts, word = windows(words)
    weight = np.fromiter(counts.values(), np.float64, len(counts))[word]
    made: list[tuple[np.ndarray, ...]] = []
    keys, first = [], []
    for n in range(ORDER):
        k, at = np.unique(grams[n], return_index=True)
        keys.append(k)
        first.append(at)
    for n in range(ORDER):
        k, at = keys[n], first[n]
        if n == ORDER - 1:
            count = np.bincount(np.searchsorted(k, grams[n]), weights=weight, minlength=len(k))
        else:  # distinct longer n-grams that end in this one
            count = np.bincount(np.searchsorted(k, grams[n][first[n + 1]]), minlength=len(k)).astype(np.float64)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        over = contexts[n - 1][at] if n else np.zeros(len(k), np.uint64)
        c, group = np.unique(over, return_inverse=True)
        total = np.bincount(group, weights=count)
        share = np.bincount(group, weights=np.minimum(count, discount)) / total
        below = np.full(len(k), np.exp(UNSEEN)) if not n else np.exp(made[-1][1][np.searchsorted(made[-1][0], grams[n - 1][at])])
        p = np.maximum(count - discount, 0) / total[group] + share[group] * below
        made.append((k, np.log(p), c, np.log(share)))
    return made


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, size: int) -> DataFrame:
    """(lang, raw, aside): about `size` bytes of text per language, one text at least, outside the held-out quarter; the text of the first hash is never aside."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2))
    known = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), raw_text(text_col).alias("raw"))
    seat = F.xxhash64("id", F.lit(6))
    totals = known.groupBy("lang").agg(F.sum(F.length("raw")).alias("total"), F.min(seat).alias("first"))
    grain = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(GRAINS))
    rows = known.join(F.broadcast(totals), "lang").where((grain * F.col("total") < float(size) * GRAINS) | (seat == F.col("first")))
    return rows.select("lang", "raw", ((F.pmod(seat, F.lit(CALIBRATION)) == 0) & (seat != F.col("first"))).alias("aside"))


def fit_language(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of one language from its sampled texts, as bytes."""
    counts: Counter = Counter()
    for raw in pdf.sort_values("raw").raw:
        counts.update(words_of(raw))
    model = kneser_ney(counts) if counts else []
    return pd.DataFrame([(pdf.lang[0], n, *(np.ascontiguousarray(a).tobytes() for a in arrays)) for n, arrays in enumerate(model)], columns=["lang", "n", "grams", "p", "contexts", "weights"])


def merged(rows: list) -> dict:
    """One table of all languages: per order sorted hashes with a column per language; NaN: unseen."""
    langs = sorted({r.lang for r in rows})
    tables = []
    for n in range(ORDER):
        own = {r.lang: [np.frombuffer(bytes(r[k]), np.uint64 if k in ("grams", "contexts") else np.float64) for k in ("grams", "p", "contexts", "weights")] for r in rows if r.n == n}
        grams = np.unique(np.concatenate([own[x][0] for x in langs])) if langs else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([own[x][2] for x in langs])) if langs else np.zeros(0, np.uint64)
        p, weights = np.full((len(grams), len(langs)), np.nan, np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        for j, x in enumerate(langs):
            p[np.searchsorted(grams, own[x][0]), j] = own[x][1]
            weights[np.searchsorted(contexts, own[x][2]), j] = own[x][3]
        tables.append((grams, p, contexts, weights))
    return {"langs": langs, "tables": tables, "heat": 20.0, "limits": {}}


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted hash is among the sorted keys, and whether it is."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Log probability of each word under each language, its end included."""
    grams, contexts, word = windows(words)
    total = np.full((grams.shape[1], len(model["langs"])), UNSEEN)
    for n, (keys, p, over, weights) in enumerate(model["tables"]):  # from the lowest order up, each overrides or backs off
        at, seen = found(over, contexts[n - 1] if n else np.zeros(grams.shape[1], np.uint64))
        backed = total + np.where(seen[:, None], weights[at], 0)
        at, seen = found(keys, grams[n])
        own = np.where(seen[:, None], p[at], np.nan)
        total = np.where(np.isnan(own), backed, own)
    sums = np.zeros((len(words), total.shape[1]))
    np.add.at(sums, word, total)
    return sums


def entropies(texts: list[bytes], model: dict, known: WordRows):
    """(characters, cross-entropy per character under each language) per text."""
    for block in in_blocks(texts, words_of):
        known.learn({w for words in block for w in words})
        for words in block:
            n = np.fromiter(words.values(), np.float64, len(words))
            size = sum(c * (len(w) + 1) for w, c in words.items())
            yield size, -(n @ known.of(words)) / size if size else None


def word_rows(model: dict) -> WordRows:
    return WordRows(len(model["langs"]), lambda words: word_scores(words, model))


def calibrate(rows: list, model: dict) -> dict:
    """Sets the temperature of the highest likelihood and each language's limit from (lang, raw) rows.

    A limit lies midway between the median entropy of the language's own texts and that of
    other languages' texts under its model: a text of a language without a model looks
    like the latter. With one language it is the median and eight deviations. Short texts
    get an allowance that falls with the root of their length.
    """
    langs, seen = model["langs"], []
    right: dict[str, list] = {x: [] for x in langs}
    wrong: dict[str, list] = {x: [] for x in langs}
    for r, (size, ce) in zip(rows, entropies([bytes(r.raw) for r in rows], model, word_rows(model)), strict=True):
        if size and r.lang in right:
            seen.append((langs.index(r.lang), min(size, 200) / 200 * (ce.min() - ce)))
            for x, c in zip(langs, ce, strict=True):
                (right if x == r.lang else wrong)[x].append((size, c))
    likelihood = lambda heat: sum(heat * gap[y] - np.log(np.exp(heat * gap).sum()) for y, gap in seen)
    model["heat"] = float(max((1, 2, 5, 10, 20, 50, 100, 200), key=likelihood))
    for x in langs:
        own = np.array([c for _, c in right[x]] or [0.0])
        middle = float(np.median(own))
        flat = (middle + float(np.median([c for _, c in wrong[x]]))) / 2 if wrong[x] else middle + 8 * max(float(own.std()), 0.05)
        spread = [abs(c - middle) * size**0.5 for size, c in right[x]] or [1.0]
        model["limits"][x] = (max(flat, middle), float(8 * np.quantile(spread, 0.9)))
    return model


def make_scorer(model: dict):
    known, langs = word_rows(model), model["langs"]

    def score(texts: list[bytes]) -> list[tuple]:
        out = []
        for size, ce in entropies(texts, model, known) if langs else ((0, None) for _ in texts):
            if not size:
                out.append(("und", 0.0, None, False))
                continue
            best = int(np.argmin(ce))
            p = 1 / np.exp(model["heat"] * min(size, 200) / 200 * (ce[best] - ce)).sum()
            flat, short = model["limits"][langs[best]]
            out.append((langs[best], float(p), float(ce[best]), bool(ce[best] <= flat + short / size**0.5)))
        return out

    return score


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES, keep: list[str] = ()) -> DataFrame:
    """Per row of `docs`: id, held_out, lang_pred, score, entropy, accepted, kept (a struct of the columns `keep`).

    lang_pred is a language of the training rows, or `und` (score 0, no entropy, not
    accepted) where the text is null or has no letter. Score is the calibrated probability
    of that language. accepted is false beyond the language's entropy limit. Learns from
    about `sample_bytes` of text per language, outside the held-out quarter; ties go to
    the first language in order; null and repeated ids keep their rows and null ids are
    never learned from; without training rows all are `und`; other columns are not read.
    """
    rows = sampled(docs, id_col, text_col, lang_col, sample_bytes)
    fitted = rows.where("not aside").groupBy("lang").applyInPandas(fit_language, "lang string, n int, grams binary, p binary, contexts binary, weights binary").collect()
    model = merged(fitted)
    if model["langs"]:
        model = calibrate(rows.where("aside").orderBy("lang", "raw").collect(), model)
    return scored(docs, model, make_scorer, id_col, text_col, "lang_pred string, score double, entropy double, accepted boolean", keep).select(
        F.col("id").alias(id_col), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score", "entropy", "accepted", *(["kept"] if keep else [])
    )
