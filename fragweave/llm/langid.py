"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes long with counts from training
text. A byte's probability in a context is its share there, or else the escape probability
times its probability in the context one byte shorter, down to a uniform distribution over
all 256 bytes (escape method C, without exclusion). The statistics are frozen after training,
so a text's exact code length under a language is a sum of looked-up values. Contexts are held
sparsely, by language and length, and each distinct gram of a batch is worked out once. The shortest code length names the language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragweave.llm.common import chunks, fold

ORDER = 3
#: Expected number of training documents of each language; a language with fewer gives all.
SAMPLE = 500
#: Code lengths are compared over this many bytes of evidence at most when they become a score.
EVIDENCE = 60.0
#: Characters whose grams are looked up together.
CHUNK = 250_000
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_LEAD = b" " * ORDER


def normal(text: str) -> bytes:
    """Lower-cased letters, everything else between them one space, after ORDER spaces of lead."""
    return _LEAD + _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


@dataclass
class Order:
    """A language's contexts of one length, sparse: what occurs in training text, and nothing else.

    pairs: sorted numbers of (context, next byte); counts: of each; contexts: sorted numbers of
    contexts; total, kinds: bytes and different bytes that follow each.
    """

    pairs: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray


@dataclass
class Model:
    """Frozen statistics: of every language, in alphabetical order, an Order for each length 0 .. ORDER."""

    langs: list[str]
    trees: list[list[Order]]


def grams(text: str) -> np.ndarray:
    """The last ORDER bytes and the next, as one number of 32 bits, at each coded byte of a text."""
    y = np.frombuffer(normal(text), np.uint8).astype(np.uint32)
    code = np.zeros(max(0, len(y) - ORDER), np.uint32)
    for j in range(ORDER + 1):
        code = code << 8 | y[j : len(y) - ORDER + j]
    return code


def tree(code: np.ndarray, count: np.ndarray) -> list[Order]:
    """The context tree of one language from its counted grams; shorter contexts are sums over longer ones."""
    out = []
    for k in range(ORDER + 1):
        pairs, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        counts = np.bincount(at, weights=count, minlength=len(pairs))
        contexts, first = np.unique(pairs >> 8, return_index=True)
        total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
        out.append(Order(pairs, counts, contexts, total, np.diff(np.append(first, len(pairs))).astype(float)))
    return out


def train_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Context trees of every language from its distinct grams and their counts."""
    langs = sorted(counts)
    return Model(langs, [tree(*counts[k]) for k in langs])


def train(texts: dict[str, list[str]]) -> Model:
    """Context trees of every language from its texts."""
    every = {k: [grams(t) for t in v] for k, v in texts.items()}
    return train_counts({k: np.unique(np.concatenate([np.zeros(0, np.uint32), *v]), return_counts=True) for k, v in every.items()})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted number among sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def bits_of(code: np.ndarray, orders: list[Order]) -> np.ndarray:
    """Code length of the next byte of each (distinct) gram under one language's tree."""
    p = np.full(len(code), 1 / 256)
    for k, o in enumerate(orders):
        pair = code & ((1 << 8 * (k + 1)) - 1)
        ctx, known = _find(o.contexts, pair >> 8)
        if not known.any():
            continue
        at, seen = _find(o.pairs, pair[known])
        total, kinds = o.total[ctx[known]], o.kinds[ctx[known]]
        p[known] = np.where(seen, o.counts[at], kinds * p[known]) / (total + kinds)
    return -np.log2(p)


def code_lengths(texts: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """([text, language] bits, bytes coded) of whole texts. Each distinct gram of the texts is looked up once."""
    per = [grams(t) for t in texts]
    sizes = np.fromiter(map(len, per), np.int64, len(per))
    out = np.zeros((len(per), len(m.langs)))
    code, at = np.unique(np.concatenate([np.zeros(0, np.uint32), *per]), return_inverse=True)
    if len(code):
        some = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[some]
        for j, orders in enumerate(m.trees):
            out[some, j] = np.add.reduceat(bits_of(code, orders)[at], begin)
    return out, sizes


def predict(texts: list[str], m: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts; `und` and 0 without a letter or without a learned language."""
    some = [i for i, t in enumerate(texts) if m.langs and _LETTER.search(t)]
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if some:
        bits, sizes = code_lengths([texts[i] for i in some], m)
        best = bits.argmin(1)
        # a posterior over at most EVIDENCE bytes: a long text is no proof that one model is right
        gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(sizes, 1))[:, None]
        score[some] = 1 / np.exp2(-gap).sum(1)
        for i, b in zip(some, best):
            lang[i] = m.langs[b]
    return lang, score


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) to counted grams of each language, summed over a bounded run of texts."""

    def rows(held: dict[str, list[np.ndarray]]) -> pd.DataFrame:
        parts = [(k, *np.unique(np.concatenate(v), return_counts=True)) for k, v in held.items()]
        return pd.concat([pd.DataFrame({"lang": k, "code": c.astype(np.int64), "n": n}) for k, c, n in parts], ignore_index=True)

    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            for i in range(0, len(text), 1 << 20) if len(text) > 1 << 20 else (0,):
                # cut texts overlap by nothing: what follows a cut begins anew, in training only
                code = grams(text[i : i + (1 << 20)])
                held.setdefault(lang, []).append(code)
                size += len(code)
                if size > 4_000_000:
                    yield rows(held)
                    held, size = {}, 0
    if held:
        yield rows(held)


def fit(docs: DataFrame, folds: int = 5, held_fold: int = 0, sample: int = SAMPLE) -> Model:
    """Trees from documents whose fold isn't held_fold and whose text and lang aren't null; null ids aren't held out.

    Of each language about `sample` documents are used, by a threshold on the hash of id and text;
    their grams are counted on the executors. What reaches the driver, and later the workers, is a
    number for each distinct gram of a language in its sample, however many languages there are. No
    documents: no languages.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold("doc_id", folds), F.lit(-1)) != held_fold))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train_counts({})
    spread = 1 << 30
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, sample / n) * spread)) for k, n in counts.items()], "lang string, upto long")
    few = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(spread)) < F.col("upto")).select("lang", "text")
    counted = few.mapInPandas(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by = counted.toPandas().sort_values(["lang", "code"])
    return train_counts({k: (d["code"].to_numpy(np.uint32), d["n"].to_numpy(np.int64)) for k, d in by.groupby("lang")})


def predictor(spark, model: Model) -> Callable:
    """A column function: text -> struct(lang, score). The frozen tables go out as one broadcast.

    They are sparse: their size is bounded by the bytes of the training sample, not by languages times contexts.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            parts = [predict(c, m) for c in chunks(s, CHUNK)]
            yield pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)})

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """documents -> (doc_id, lang_pred, score), a row per row, repeated ones and null ids too.

    Null texts and texts without a letter are `und`, as is all where no language was learnt. Ties go
    to the language first by name. Whole texts count, however long. No documents: no rows.
    """
    p = predictor(docs.sparkSession, model)
    return docs.select("doc_id", p("text").alias("p")).select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
