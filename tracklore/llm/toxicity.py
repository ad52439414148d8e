"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence in a document of a hashed character n-gram of its letter runs
(the whole run included). Each is scaled by the log of the ratio of its smoothed shares
in toxic and other documents; logistic regression is then fitted on a bounded sample.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, in_blocks, labelled_sample, ngram_buckets, scored, trained

BUCKETS, SHORTEST, LONGEST = 1 << 18, 3, 6
SAMPLE, ROUNDS, RATE, PENALTY, LEAST_RATIO, LEAST_DOCS = 12000, 150, 0.3, 1e-3, 1.5, 5
REMEMBERED = 1 << 18
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(raw: bytes) -> set[str]:
    return set(LETTERS.findall(raw.decode("utf-8", "replace").lower()))


def document_features(raw: bytes) -> tuple[bytes, bytes]:
    """Distinct buckets of a text's n-grams, as int32 bytes."""
    words = words_of(raw)
    ids = np.unique(ngram_buckets(list(words), SHORTEST, LONGEST, BUCKETS)[0]) if words else np.zeros(0)
    return ids.astype(np.int32).tobytes(), b""


def fit(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each bucket, its ratio included, and the bias."""
    if not rows:
        return np.zeros(BUCKETS), np.zeros(1)
    labels = np.array([r[0] for r in rows], np.float64)
    counts = np.zeros((2, BUCKETS))
    for label, ids, _ in rows:
        counts[label, ids] += 1  # a row's ids are distinct
    share = (counts + 1) / (np.array([[len(rows) - labels.sum()], [labels.sum()]]) + 2)
    ratio = np.log(share[1] / share[0])
    used = (counts.sum(axis=0) >= LEAST_DOCS) & (np.abs(ratio) >= LEAST_RATIO)
    kept = [ids[used[ids]] for _, ids, _ in rows]
    ids, row = np.concatenate(kept), np.repeat(np.arange(len(rows)), [len(k) for k in kept])
    value = ratio[ids].astype(np.float32)
    weights, bias = np.zeros(BUCKETS), 0.0
    slope, slope_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(ROUNDS):  # full-batch steps sized by past gradients
        z = np.bincount(row, weights=value * weights[ids], minlength=len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        gradient = np.bincount(ids, weights=value * off[row], minlength=BUCKETS) + PENALTY * weights
        slope += gradient**2
        slope_bias += off.sum() ** 2
        weights -= RATE * gradient / np.sqrt(slope) * used
        bias -= RATE * off.sum() / slope_bias**0.5
    return weights * ratio, np.array([bias])


class Weighted:
    """Per word the buckets of its n-grams that have a weight; most words have none."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: set[str] = set()
        self.hits: dict[str, np.ndarray] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.hits.clear()
        new = list(words - self.known)
        if not new:
            return
        ids, word = ngram_buckets(new, SHORTEST, LONGEST, BUCKETS)
        kept = self.weights[ids] != 0
        ids, word = ids[kept], word[kept]
        order = np.argsort(word, kind="stable")
        ids, word = ids[order], word[order]
        at, starts = np.unique(word, return_index=True)
        if len(ids):
            self.hits.update((new[k], part) for k, part in zip(at, np.split(ids, starts[1:]), strict=True))
        self.known.update(new)


def make_scorer(model: tuple[np.ndarray, float]):
    weights, bias = model
    weighted = Weighted(weights)

    def score(texts: list[bytes]) -> list[tuple[float]]:
        out = []
        for block in in_blocks(texts, words_of):
            weighted.learn(set().union(*block))
            for words in block:
                parts = [weighted.hits[w] for w in words if w in weighted.hits]
                z = (weights[np.unique(np.concatenate(parts))].sum() if parts else 0.0) + bias
                out.append((float(1 / (1 + np.exp(-min(50.0, max(-50.0, z))))),))
        return out

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE, least: float = 0.7) -> DataFrame:
    """Per row of `docs`: id, held_out, score, predicted (score >= `least`).

    Learns from about `sample` labelled rows at most, half of each class where it has so
    many, outside the held-out third; the score is corrected for the classes' true
    shares. Null and empty texts and texts without letters get the bias alone; null and
    repeated ids keep their rows; without labels every score is 0.5; an empty table gives
    an empty result; other columns are not read.
    """
    rows, shift = labelled_sample(docs, labels, label, 3, 1, sample, id_col, text_col)
    weights, bias = trained(rows, document_features, fit)
    return scored(docs, (weights, float(bias[0]) + shift), make_scorer, id_col, text_col, "score double").select(
        F.col("id").alias(id_col), held_out("id", 3, 1).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
