"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one per word and per character n-gram of
the word, hashed into `BUCKETS`, and one for each further occurrence of a longer word. A
softmax over the average gives the score. Vectors and output are trained by stochastic
gradient descent in numpy on a bounded sample.

The output is linear in the average, so a trained bucket acts through one number: its
vector's product with the difference of the two output rows. A word's share of the
average is then two numbers (sum and count), remembered per task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import WordRows, held_out, in_blocks, labelled_sample, ngram_buckets, scored, trained

BUCKETS, SIZE, SHORTEST, LONGEST, REPEATED = 1 << 16, 16, 2, 4, 4
SAMPLE, EPOCHS, RATE = 6000, 6, 0.5
AGAIN = 0  # the bucket of further occurrences


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the words and their character n-grams."""
    ids, word = ngram_buckets([w.decode("utf-8", "replace") for w in words], SHORTEST, LONGEST, BUCKETS - 1)
    return ids + 1, word


def document_features(raw: bytes) -> tuple[bytes, bytes]:
    """Distinct buckets of a text and how often each occurs, as int32 bytes."""
    words = Counter(raw.split())
    n = np.fromiter(words.values(), np.int64, len(words))
    counts = np.zeros(BUCKETS, np.int64)
    if words:
        ids, word = features_of(list(words))
        np.add.at(counts, ids, n[word])
    counts[AGAIN] = sum(c - 1 for w, c in words.items() if c > 1 and len(w) >= REPEATED)
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32).tobytes(), counts[ids].astype(np.int32).tobytes()


def fit(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The number each bucket acts through, and the bias."""
    r = np.random.default_rng(7)
    vectors = r.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    output, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in r.permutation(len(rows)):
            label, ids, counts = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[ids]
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            vectors[ids] -= rate * len(ids) ** 0.5 * share[:, None] * back
    return vectors @ (output[1] - output[0]), np.array([bias[1] - bias[0]])


def make_scorer(model: tuple[np.ndarray, float]):
    weights, bias = model

    def rows(words: list[bytes]) -> np.ndarray:
        ids, word = features_of(words)
        return np.stack([np.bincount(word, weights=weights[ids], minlength=len(words)), np.bincount(word, minlength=len(words))], axis=1)

    known = WordRows(2, rows)

    def score(texts: list[bytes]) -> list[tuple[float]]:
        out = []
        for block in in_blocks(texts, lambda raw: Counter(raw.split())):
            known.learn({w for words in block for w in words})
            for words in block:
                n = np.fromiter(words.values(), np.float64, len(words))
                total, size = n @ known.of(words) if len(words) else (0.0, 0.0)
                again = sum(c - 1 for w, c in words.items() if c > 1 and len(w) >= REPEATED)
                logit = (total + again * weights[AGAIN]) / max(1.0, size + again) + bias
                out.append((float(1 / (1 + np.exp(-logit))),))
        return out

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE, keep: list[str] = ()) -> DataFrame:
    """Per row of `docs`: id, held_out, score, predicted, kept (a struct of the columns `keep`).

    Learns from about `sample` labelled rows at most, half of each class, outside the
    held-out third; the score is corrected for the classes' true shares. Null and empty
    texts get the score of an average without words; null and repeated ids keep their
    rows; without labels every score is 0.5; an empty table gives an empty result; other
    columns are not read.
    """
    rows, shift = labelled_sample(docs, labels, label, 3, 1, sample, id_col, text_col)
    weights, bias = trained(rows, document_features, fit)
    return scored(docs, (weights.astype(np.float64), float(bias[0]) + shift), make_scorer, id_col, text_col, "score double", keep).select(
        F.col("id").alias(id_col), held_out("id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["kept"] if keep else [])
    )
