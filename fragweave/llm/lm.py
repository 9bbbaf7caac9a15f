"""Log-likelihood of documents under a gated recurrent model and under a unigram base.

Counts of all words cover every training document. The recurrent model predicts the most
frequent words themselves and all others as a bucket (by their last two bytes); a word's share
of its bucket comes from the counts. Frequent words are looked up in a table of bounded size;
all others are joined with their counts by hash, so nothing that grows with the vocabulary is
broadcast or collected. The recurrent weights start from a bounded sample of documents; from
there every partition passes once over all of its training documents, and the partitions'
weights are averaged by the symbols that they have seen. Texts are split into words twice: to
count, and to train, which leaves every text's symbols in a checkpoint for the scoring.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fragweave.llm import gru
from fragweave.llm.common import Memo, fold
from fragweave.session import cut_lineage

#: Words that are looked up without a join; words that the model predicts; buckets for the others.
FREQUENT, SHORTLIST, BUCKETS, CLASSES = 200_000, 2000, 64, 48
#: Documents (expected number) and symbols that the recurrent weights start from, before the pass over all documents.
SAMPLE, TOKENS = 6000, 3_000_000
#: The key of the end symbol; words have the signed 64-bit XXH64 of their bytes.
END = 0
ALPHA = 0.1
#: Bytes of text that are counted, or encoded, at a time; a longer text is one piece. Bytes of symbols scored at a time.
COUNT_BYTES, ENCODE_BYTES, SCORE_BYTES = 20_000_000, 8_000_000, 8_000_000


def keys_of(words) -> np.ndarray:
    """Signed 64-bit XXH64 of each word; 0, which is the end symbol's, becomes 1."""
    x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    x[x == END] = 1
    return x


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def buckets_of(words: list[bytes]) -> np.ndarray:
    """bucket_of() each word, worked out once for each pair of last bytes."""
    known = Memo(bucket_of, 1 << 17)
    return np.fromiter([known[w[-2:]] for w in words], np.int64, len(words))


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """The column in order, in slices of about `most` bytes, each with its place; no value is cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, column.slice(at, upto - at)
        at = upto


def coded(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words as of folded_words(): the distinct ones, the place of every text's words in that list, end to end, and the texts' edges there.

    Arrow splits at the same six characters and lower-cases A-Z alone; the empty words that it leaves at either end of a text have no place.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found, edges = lists.values.dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    del lists
    words = found.dictionary.cast(pa.binary()).to_pylist()
    places = found.indices.to_numpy()
    del found
    if b"" in words:
        empty = np.flatnonzero(places == words.index(b""))
        places, edges = np.delete(places, empty), edges - np.searchsorted(empty, edges)
    return words, places, edges


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of whole texts to counted keys, summed over a bounded run of texts."""
    for batch in batches:
        for _, texts in pieces(batch.column(0), COUNT_BYTES):
            words, places, _ = coded(texts)
            n = np.zeros(len(words), np.int64)
            for at in range(0, len(places), 500_000):  # bincount() copies what it counts to 64 bits
                n += np.bincount(places[at : at + 500_000], minlength=len(words))
            del places
            words, n = [w for w in words if w], n[[bool(w) for w in words]]
            rows = (np.append(keys_of(words), END), np.append(buckets_of(words), -1).astype(np.int32), np.append(n, len(texts)).astype(np.int64))
            del words, n
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["key", "bucket", "n"])
            pa.default_memory_pool().release_unused()  # the worker stays for the next stages


class Lexicon:
    """What a worker needs: frequent keys with counts, the model's symbols, totals by bucket."""

    def __init__(self, key: np.ndarray, bucket: np.ndarray, n: np.ndarray, buckets: dict[int, tuple[int, int]], total: int, distinct: int):
        """key, bucket, n: the frequent words and the end. buckets: tokens and kinds of all words by bucket."""
        self.total, self.distinct = total, distinct
        is_end = key == END
        self.end_count = int(n[is_end].sum())
        key, bucket, n = key[~is_end], bucket[~is_end], n[~is_end]
        order = np.lexsort((key, -n))
        key, bucket, n = key[order], bucket[order], n[order]
        tokens = np.array([buckets.get(b, (0, 0))[0] for b in range(BUCKETS)], float)
        kinds = np.array([buckets.get(b, (0, 0))[1] for b in range(BUCKETS)], float)
        top = min(SHORTLIST, len(key))
        np.subtract.at(tokens, bucket[:top], n[:top])
        np.subtract.at(kinds, bucket[:top], 1)
        counts = np.concatenate([n[:top], tokens, [self.end_count]]).astype(float)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(counts), np.int64)
        place[order] = np.arange(len(counts))
        self.counts = counts[order]
        self.symbol_end = int(place[-1])
        self.bucket_symbol = place[top : top + BUCKETS]
        #: log10 of the smoothed total of each bucket, by which a word's own smoothed count is divided
        self.bucket_log = np.log10(tokens + ALPHA * (kinds + 1))
        self.symbol = dict(zip(key[:top].tolist(), place[:top].tolist()))
        order = np.argsort(key)
        self.keys, self.n = key[order], n[order]

    def entries(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: symbol; key if it needs the join, else 0; log10(count + ALPHA), or 0 then; log10 that it adds to its symbol's."""
        key = keys_of(words)
        bucket = buckets_of(words)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        found = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        own = np.log10((self.n[at] if len(self.keys) else np.ones(len(key))) + ALPHA) * found
        short = np.fromiter(map(self.symbol.get, key.tolist(), repeat(-1)), np.int64, len(key))
        listed = short >= 0
        return np.where(listed, short, self.bucket_symbol[bucket]), np.where(found, 0, key), own, np.where(listed, 0.0, own - self.bucket_log[bucket])


class Words:
    """Words met so far with their entries(), looked up by place; forgotten beyond `most`, so memory is bounded."""

    def __init__(self, lex: Lexicon, most: int = 600_000):
        self.lex, self.most = lex, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]

    def look(self, words: list[bytes]) -> np.ndarray:
        """Places of the words, which differ from each other; columns hold their entries until the next call."""
        if len(self.place) > self.most:
            self._clear()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new, n = [words[i] for i in fresh.tolist()], len(self.place)
            at[fresh] = np.arange(n, n + len(fresh))
            self.place.update(zip(new, at[fresh].tolist()))
            self.columns = [np.concatenate(c) for c in zip(self.columns, self.lex.entries(new))]
        return at


def _split(symbol: np.ndarray, edges: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts end to end, each text's end included, and the texts' edges there."""
    return np.insert(symbol.astype("<u2", copy=False), edges[1:], end), edges + np.arange(len(edges))


def _symbols(words):
    """Texts to the model's symbols, the end included, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = words.value
        known = Words(lex)
        for batch in batches:
            for _, texts in pieces(batch.column(0), ENCODE_BYTES):
                distinct, places, edges = coded(texts)
                at = known.look(distinct)
                flat, edges = _split(known.columns[0][at][places], edges, lex.symbol_end)
                yield pa.RecordBatch.from_arrays([_binary(flat, edges)], ["s"])

    return run


def _binary(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Slices of 16-bit numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 2).astype("<i4")), pa.py_buffer(flat)])


def _encoder(shared, held_fold: int, schema: pa.Schema):
    """Of each text: the base score and what the model's needs, its symbols among it. Meanwhile one pass of training over
    all training texts of the partition, streamed through a bounded number of lanes; the weights come in a last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        model = copy.deepcopy(model)
        words, done = Words(lex), []
        scale = np.log10(lex.total + ALPHA * (lex.distinct + 1))
        end_log = float(np.log10(lex.end_count + ALPHA))
        row = TaskContext.get().partitionId() << 36

        def training() -> Iterator[np.ndarray]:
            nonlocal row
            for batch in batches:
                for first, texts in pieces(batch.column("text"), ENCODE_BYTES):
                    n = len(texts)
                    distinct, places, edges = coded(texts)
                    at = words.look(distinct)
                    symbol, key, own, inside = (c[at] for c in words.columns)
                    symbol, key = symbol.astype("<u2")[places], key[places]
                    text = np.repeat(np.arange(n), np.diff(edges))
                    own, inside = np.bincount(text, own[places], n), np.bincount(text, inside[places], n)
                    rare = np.flatnonzero(key)
                    rare_text, rare_key = text[rare], key[rare]
                    del text, key, places
                    order = np.lexsort((rare_key, rare_text))
                    rare_text, rare_key = rare_text[order], rare_key[order]
                    new = np.flatnonzero(np.diff(rare_text, prepend=-1) | (np.diff(rare_key, prepend=0) != 0))
                    tokens = np.diff(edges) + 1
                    lists = pa.array(np.searchsorted(rare_text[new], np.arange(n + 1)).astype(np.int32))
                    flat, edges = _split(symbol, edges, lex.symbol_end)
                    held = batch.column("f").slice(first, n).to_numpy() == held_fold
                    columns = {
                        "row": np.arange(row, row + n),
                        "doc_id": batch.column("doc_id").slice(first, n),
                        "held_out": held,
                        "n_tokens": tokens,
                        "known": tokens - 1 - np.bincount(rare_text, minlength=n) + int(lex.end_count > 0),
                        "base": own + end_log - tokens * scale,
                        "inside": inside,
                        "keys": pa.ListArray.from_arrays(lists, pa.array(rare_key[new])),
                        "times": pa.ListArray.from_arrays(lists, pa.array(np.diff(new, append=len(rare)).astype(np.int32))),
                        "symbols": _binary(flat, edges),
                        "w": pa.nulls(n, pa.binary()),
                    }
                    row += n
                    done.append(_batch(columns, schema))
                    pa.default_memory_pool().release_unused()
                    for i in np.flatnonzero(~held).tolist():
                        yield flat[edges[i] : edges[i + 1]]

        for met in gru.passing(model, training(), lex.symbol_end):
            yield from done
            done.clear()
        if met.any():
            w = {c: pa.nulls(1, schema.field(c).type) for c in schema.names}
            yield _batch(w | {"w": pa.array([gru.packed(model, met).tobytes()], pa.binary())}, schema)

    return run


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Columns in the schema's order and types."""
    made = (c if isinstance(c, pa.Array) else pa.array(c) for c in (columns[name] for name in schema.names))
    return pa.RecordBatch.from_arrays([c if c.type == t else c.cast(t) for c, t in zip(made, schema.types)], schema=schema)


def _scorer(shared):
    """The model's score of encoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        for batch in batches:
            for first, symbols in pieces(batch.column("symbols"), SCORE_BYTES):
                part = batch.slice(first, len(symbols))
                likely = gru.score(model, [np.frombuffer(s, "<u2") for s in symbols.to_pylist()], lex.symbol_end) / np.log(10)
                kept = [c for c in batch.schema.names if c not in ("symbols", "inside")]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(likely + part.column("inside").to_numpy())], [*kept, "model"])

    return run


def likelihoods(docs: DataFrame, folds: int = 10, held_fold: int = 0, sample: int = SAMPLE, tokens: int = TOKENS) -> DataFrame:
    """documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row.

    Learns from all documents whose fold isn't held_fold; sample and tokens bound the start only.
    Null texts are empty: one end symbol. Scores are log10 probabilities. Words of training texts beyond the model's shortlist are predicted by
    bucket, then by their smoothed share of it; a word no training text has gets the share of one
    unseen word. Null ids are trained on and not held out. Whole texts count, however long; repeated
    rows stay. No training documents: base_score 0. No documents: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", folds), F.lit(-1)).alias("f"))
    training = rows.where(F.col("f") != held_fold)
    counted = training.select("text").mapInArrow(_count, "key long, bucket int, n long")
    counts = cut_lineage(counted.groupBy("key").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")))
    by_bucket = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = sum(r.n for r in by_bucket), sum(r.v for r in by_bucket)
    # the frequent words are those above the least count that leaves at most FREQUENT of them;
    # counts are told apart to 1 in 64 of an octave, so the histogram stays small
    level = F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 4096)
    bar, have = 1 << 60, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
        have += r.words
        if have > FREQUENT:
            break
        bar = r.level
    cut = counts.where((level >= bar) | (F.col("key") == END)).select("key", "bucket", "n").toArrow()
    lex = Lexicon(*(cut.column(c).to_numpy() for c in ("key", "bucket", "n")), {r.bucket: (r.n, r.v) for r in by_bucket if r.bucket >= 0}, total, distinct)
    spread = 1 << 30
    few = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < int(min(1.0, sample / max(1, lex.end_count)) * spread)).select("text")
    words = spark.sparkContext.broadcast(lex)
    learn = [np.frombuffer(r.s, "<u2").astype(np.int64) for r in few.mapInArrow(_symbols(words), "s binary").collect()]
    learn.sort(key=lambda x: (len(x), x.tobytes()))  # independent of the order of tasks
    # symbols number at most SHORTLIST + BUCKETS + 1, so the weights are under 2 MB
    model = gru.train(gru.start(lex.counts, CLASSES), learn, lex.symbol_end, tokens)
    begun = spark.sparkContext.broadcast((lex, model))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, inside double, keys array<long>, times array<int>, symbols binary, w binary"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    encoded = cut_lineage(rows.mapInArrow(_encoder(begun, held_fold, arrow), schema))
    if lex.end_count:
        # a vector of 2 MB a partition, added up in a tree, so that few reach the driver
        passed = encoded.where("w is not null").select("w").rdd.map(lambda r: np.frombuffer(r.w))
        model = gru.averaged(model, passed.treeReduce(np.add, 3))
    shared = spark.sparkContext.broadcast((lex, model))
    encoded = encoded.where("w is null").drop("w")
    scored = encoded.drop("keys", "times").mapInArrow(_scorer(shared), f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double")
    rare = encoded.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("t"))
    # no key here is frequent: the hundred-thousands of words above them in rank are in the table
    rare = rare.join(counts.select("key", "n"), "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("t") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("own"), F.sum(F.when(F.col("n").isNotNull(), F.col("t")).otherwise(0)).alias("more"))
    out = scored.join(rare, "row", "left")
    own = F.coalesce("own", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + own).alias("base_score"), (F.col("model") + own).alias("score"))
