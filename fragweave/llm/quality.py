"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A document is the mean over its n-grams of one-hot vectors in 2^BITS hashed dimensions, so a
score is one sparse dot product: the mean of the weights its n-grams hash to, plus a bias.
N-grams are over words and single punctuation marks, as written (one and two in a row), over
their letter-case shapes (three in a row), and one for a word that repeats its predecessor.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragweave.llm.common import Memo, chunks, fold

BITS = 18
#: Most labelled rows that training uses: those with the smallest hash of their id.
SAMPLE = 6000
EPOCHS = 4
#: Features are shares of a document's n-grams; this brings them to the order of one.
GAIN = 8.0
ALPHA, BETA, L1, L2 = 0.5, 0.05, 1e-4, 1e-4

_TOKEN = re.compile(r"\w+|[^\w\s]")
_MASK = np.uint64((1 << BITS) - 1)


def _shape(tok: str) -> int:
    if not tok[0].isalnum():
        return 16 + ord(tok[0]) % 4096
    if tok.isdigit():
        return 1
    if tok.isupper():
        return 2 if len(tok) > 1 else 3
    return 4 if tok[:1].isupper() else 5


def _code(tok: str) -> int:
    return zlib.crc32(tok.encode("utf-8", "replace")) << 16 | _shape(tok)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


def buckets(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, document of each n-gram) of whole texts, unsorted."""
    per = [_TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, per), np.int64, len(per))
    code = np.fromiter((memo[x] for p in per for x in p), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(len(per), dtype=np.int32), sizes)
    h, s = code >> np.uint64(16), code & np.uint64(0xFFFF)
    two, three = of[1:] == of[:-1], of[2:] == of[:-2]
    pair = (h[:-1] * np.uint64(0x100000001B3) + h[1:])[two]
    same = (h[:-1] == h[1:]) & two
    shapes = ((s[:-2] << np.uint64(32)) + (s[1:-1] << np.uint64(16)) + s[2:])[three]
    parts = [_mix(h, 1), _mix(pair, 2), _mix(shapes, 3), _mix(np.full(int(same.sum()), 7, np.uint64), 4)]
    return np.concatenate(parts), np.concatenate([of, of[1:][two], of[2:][three], of[1:][same]])


def scores(texts: list[str], weights: np.ndarray, bias: float, memo: Memo) -> np.ndarray:
    """Probability of label 1 of each whole text; a text without n-grams has the bias alone."""
    b, of = buckets(texts, memo)
    total = np.bincount(of, weights=weights[b], minlength=len(texts))
    count = np.bincount(of, minlength=len(texts))
    z = bias + GAIN * total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (buckets, shares, label) rows -> (weights, bias). One class or none: the prior alone."""
    n = 1 << BITS
    labels = np.array([r[2] for r in rows], float)
    prior = (labels.sum() + 1) / (len(rows) + 2)
    bias0 = float(np.log(prior / (1 - prior)))
    if len(set(labels.tolist())) < 2:
        return np.zeros(n, np.float32), bias0
    # both classes weigh the same in total, so that a rare one is learnt; the prior comes back as the bias
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)
    rng = np.random.default_rng(17)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            idx, x, y = rows[r]
            idx = np.append(idx, n)
            x = np.append(GAIN * x, 1.0)
            zi, gi = z[idx], g2[idx]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(gi)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
            g = weight[r] * (p - y) * x
            sigma = (np.sqrt(gi + g * g) - np.sqrt(gi)) / ALPHA
            z[idx] = zi + g - sigma * w
            g2[idx] = gi + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2))
    return w[:n].astype(np.float32), float(w[n])


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled texts to their distinct buckets with shares, a batch at a time."""
    memo = Memo(_code)
    for pdf in batches:
        idx, x = [], []
        for text in pdf["text"]:
            b, count = np.unique(buckets([text or ""], memo)[0], return_counts=True)
            idx.append(b.astype("<i4").tobytes())
            x.append((count / max(1, count.sum())).astype("<f4").tobytes())
        yield pd.DataFrame({"idx": idx, "x": x, "y": pdf["y"].astype("int32")})


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows whose fold isn't held_fold.

    At most `sample` labelled ids are used, those with the smallest hash of the id, each with one
    text (of several the smallest), so what reaches the driver is at most `sample` rows of at most
    2^BITS buckets (sparse counts, not texts). Null ids and labels are left out; of ids labelled
    twice the smaller label counts; null texts are empty. No labelled rows: the prior alone.
    """
    few = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold("doc_id", folds) != held_fold))
    few = few.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # pre-aggregated in each task, so a repeated id is one row a task before the shuffle
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    got = rows.select("text", "y").mapInPandas(_features, "idx binary, x binary, y int").collect()
    decoded = [(np.frombuffer(r.idx, "<i4"), np.frombuffer(r.x, "<f4").astype(float), r.y) for r in got]
    decoded.sort(key=lambda r: (len(r[0]), zlib.crc32(r[0].tobytes())))  # independent of the order of tasks
    return train(decoded)


def scorer(model: tuple[np.ndarray, float]) -> Callable:
    """A column function: text -> probability of label 1."""
    weights, bias = model

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo(_code)
        for s in batches:
            parts = [scores(c, weights, bias, memo) for c in chunks(s)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def classify(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """documents -> (doc_id, score, predicted), a row per row, repeated ones and null ids too.

    Null and empty texts get the bias alone. Whole texts count, however long. No documents: no rows.
    """
    out = docs.select("doc_id", scorer(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
