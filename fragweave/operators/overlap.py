"""Suffix-to-prefix overlaps between the fragments of a dataset.

The indexed plan replaces the all-pairs theta join by an equi-join on seeds. A dataset of up to
GATHER bytes is gathered and joined within a task; larger ones are joined by shuffles. An overlap of at
least m bytes with at most k mismatches has, among k + 1 blocks of the right fragment's first
m bytes, one that the left fragment repeats exactly. A block and every stretch of its length on
the left are each represented by their minimiser (the k-mer of the smallest hash in the
stretch), which neighbouring stretches mostly share, so that a left fragment emits a fraction
of its positions. Candidates are grouped by pair and verified on the bytes; nothing is missed
and nothing false is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.functions.bytes import mismatches, prefix, suffix

KMER = 8
#: Bytes of a dataset's fragments up to which a task joins its seeds by itself: seeds are several times as large as
#: the fragments, so that none of them is written. The seeds of larger datasets are joined by shuffles.
GATHER = 4_000_000
#: Bytes of fragments and pairs of seeds that a task handles at once.
RAW, SEEDS = 2_000_000, 1_000_000


def _no_details() -> Column:
    return F.array().cast("array<struct<overlap_offset:bigint,left_byte:smallint,right_byte:smallint>>")


def exact_overlap(left: Column | str, right: Column | str, least: int = 1) -> Column:
    """Longest n >= least with the last n bytes of left equal to the first n of right; 0 if none."""
    l, r = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    most = F.least(F.length(l), F.length(r))
    found = F.filter(F.sequence(most, F.lit(least), F.lit(-1)), lambda n: suffix(l, n) == prefix(r, n))
    return F.when(most < least, 0).otherwise(F.coalesce(F.get(found, 0), F.lit(0))).cast("bigint")


def _choose(ns: Column, l: Column, r: Column, k: int) -> Column:
    """The overlap among candidate lengths: the longest exact one, else the longest with at most k mismatches; null if none."""
    exact = F.array_max(F.filter(ns, lambda n: suffix(l, n) == prefix(r, n)))
    if not k:
        return exact
    near = F.array_max(F.filter(ns, lambda n: F.size(mismatches(suffix(l, n), prefix(r, n))) <= k))
    return F.when(exact.isNotNull(), exact).otherwise(near)


def tolerant_overlap(left: Column | str, right: Column | str, least: int, k: int) -> Column:
    """struct(length, matches, mismatches, exact, mismatch_details): exact first, then longest with at most k mismatches."""
    if least < 1:
        raise ValueError("the least overlap has to be positive")
    l, r = (F.col(x) if isinstance(x, str) else x for x in (left, right))
    most = F.least(F.length(l), F.length(r))
    n = F.when(most >= least, _choose(F.sequence(F.lit(least), most), l, r, k))
    d = F.when(n.isNull(), _no_details()).otherwise(mismatches(suffix(l, n), prefix(r, n)))
    n = F.coalesce(n, F.lit(0)).cast("bigint")
    miss = F.size(d).cast("bigint")
    return F.struct(n.alias("length"), (n - miss).alias("matches"), miss.alias("mismatches"), ((n > 0) & (miss == 0)).alias("exact"), d.alias("mismatch_details"))


def _once(name: str, value: Column) -> Column:
    """A column that is computed once however often plans above refer to it: what a generator makes can't be inlined."""
    return F.explode(F.array(value)).alias(name)


def _verifier(k: int):
    """Pairs with candidate lengths to edges: the longest exact overlap, else the longest with at most k mismatches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ds, src, dst, l, r, ns in zip(pdf["dataset_id"], pdf["src"], pdf["dst"], pdf["l"], pdf["r"], pdf["ns"]):
                lengths = sorted((int(n) for n in ns), reverse=True)
                n = next((n for n in lengths if l[len(l) - n :] == r[:n]), 0)
                details = []
                if not n:
                    x, y = np.frombuffer(l, np.uint8), np.frombuffer(r, np.uint8)
                    for n in lengths:
                        at = np.flatnonzero(x[len(x) - n :] != y[:n])
                        if len(at) <= k:
                            details = [{"overlap_offset": int(i), "left_byte": int(x[len(x) - n + i]), "right_byte": int(y[i])} for i in at]
                            break
                    else:
                        continue
                rows.append((ds, src, dst, n, n - len(details), len(details), not details, details))
            yield pd.DataFrame(rows, columns=["dataset_id", "src", "dst", "overlap", "matches", "mismatches", "exact", "mismatch_details"])

    return run


def _edges(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (dataset_id, src, dst, l, r, ns) to the edge table. Exact ones stay on the JVM side."""
    if k:
        kind = dict(pairs.dtypes)["dataset_id"]
        detail = "array<struct<overlap_offset:bigint,left_byte:smallint,right_byte:smallint>>"
        return pairs.select("dataset_id", "src", "dst", "l", "r", "ns").mapInPandas(_verifier(k), f"dataset_id {kind}, src long, dst long, overlap long, matches long, mismatches long, exact boolean, mismatch_details {detail}")
    n = F.array_max(F.filter("ns", lambda n: suffix(F.col("l"), n) == prefix(F.col("r"), n))).cast("bigint")
    out = pairs.select("dataset_id", "src", "dst", _once("overlap", n)).where("overlap is not null")
    return out.select("dataset_id", "src", "dst", "overlap", F.col("overlap").alias("matches"), F.lit(0).cast("bigint").alias("mismatches"), F.lit(True).alias("exact"), _no_details().alias("mismatch_details"))


def exhaustive_edges(frags: DataFrame, least: int, k: int = 0) -> DataFrame:
    """All ordered pairs of a dataset compared: the baseline that the indexed plan is held against; quadratic."""
    if least < 1:
        raise ValueError("the least overlap has to be positive")
    f = frags.where(F.length("data") >= least)
    a = f.select("dataset_id", F.col("node_id").alias("src"), F.col("data").alias("l"))
    b = f.select("dataset_id", F.col("node_id").alias("dst"), F.col("data").alias("r"))
    most = F.least(F.length("l"), F.length("r"))
    return _edges(a.join(b, "dataset_id").where("src <> dst").withColumn("ns", F.sequence(F.lit(least), most)), k)


def _keys(data: np.ndarray, kmer: int) -> np.ndarray:
    """A 64-bit number of each stretch of kmer (8 at most) bytes, different for different bytes, evenly spread."""
    n = max(0, len(data) - kmer + 1)
    v = np.zeros(n, np.uint64)
    for j in range(kmer):
        v = (v << np.uint64(8)) | data[j : n + j].astype(np.uint64)
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _least(order: np.ndarray, wide: int) -> np.ndarray:
    """Minimum of every stretch of `wide` numbers, by doubling."""
    span = 1
    while 2 * span <= wide:
        order = np.minimum(order[:-span], order[span:])
        span *= 2
    rest = wide - span
    return np.minimum(order[: len(order) - rest], order[rest:]) if rest else order


def minimisers(data: np.ndarray, place: np.ndarray, kmer: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): of every stretch of `block` bytes, where its minimiser begins.

    place: each byte's place in its fragment. Stretches across fragments are meaningless. The
    minimiser has the least upper bits of the key, and of several the leftmost, so it depends on
    the bytes of the stretch alone.
    """
    v = _keys(data, kmer)
    low = np.uint64(0xFFFFFFFF)
    # places are below 2^32; a key's upper half decides, then the place
    order = (v & ~low) | place[: len(v)].astype(np.uint64)
    return v, (_least(order, block - kmer + 1) & low).astype(np.int64) if len(v) >= block - kmer + 1 else np.zeros(0, np.int64)


def _seeds(least: int, k: int, left: bool):
    """Fragments to seeds: of the left side every minimiser, of the right side those of the first k + 1 blocks."""
    block = least // (k + 1)
    kmer = min(KMER, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = pdf["data"].map(len).to_numpy(np.int64)
            first = 0
            while first < len(pdf):
                # a bounded run of fragments, whole ones, side by side
                last = first + max(1, int(np.searchsorted(np.cumsum(held[first:]), 4_000_000, "right")))
                n = held[first:last]
                raw = np.frombuffer(b"".join(pdf["data"].iloc[first:last]), np.uint8)
                of = np.repeat(np.arange(first, first + len(n)), n)
                begin = np.cumsum(n) - n
                place = np.arange(len(raw)) - np.repeat(begin, n)
                v, where = minimisers(raw, place, kmer, block)
                if left:
                    # stretches within a fragment; neighbours mostly share their minimiser
                    at = np.flatnonzero(place[: len(where)] + block <= held[of[: len(where)]])
                    new = np.ones(len(at), bool)
                    new[1:] = (where[at][1:] != where[at][:-1]) | (of[at][1:] != of[at][:-1])
                    at = at[new]
                else:
                    at = (begin[:, None] + np.arange(k + 1) * block).ravel()
                row = of[at]
                yield pd.DataFrame({c: pdf[c].to_numpy()[row] for c in ("dataset_id", "node_id", "size")} | {"key": v[begin[row - first] + where[at]].view(np.int64), "at": where[at]})
                first = last

    return run


def _runs(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, owners) of the stretches begin[i] .. begin[i] + n[i], one after another."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + begin[owner], owner


def _portions(cost: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours that cost at most so much together, or of one that costs more."""
    ends, first = np.cumsum(cost), 0
    while first < len(cost):
        spent = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, spent + most, "right")))
        yield slice(first, last)
        first = last


def _longest(a: np.ndarray, b: np.ndarray, n: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Places of the best candidate of each pair: exact ones first, then the longest."""
    order = np.lexsort((-n, ~exact, b, a))
    a, b = a[order], b[order]
    return order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order


def overlaps(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, of: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, length, exact) of the edges between fragments of the same dataset, by the seeds they share.

    Fragment i has the bytes raw[begin[i] : begin[i] + size[i]], at least `least` of them, and is of
    dataset of[i]; fragments lie side by side. Candidates are compared by sums that equal bytes
    have in common; what is chosen is compared byte by byte.
    """
    block = least // (k + 1)
    kmer = min(KMER, block)
    frag = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(raw)) - begin[frag]
    key, where = minimisers(raw, place, kmer, block)
    at = np.flatnonzero(place[: len(where)] + block <= size[frag[: len(where)]])
    at = at[np.concatenate([[True], (where[at][1:] != where[at][:-1]) | (frag[at][1:] != frag[at][:-1])])]
    apart = np.uint64(0x9E3779B97F4A7C15)  # a dataset's keys are moved by its number; what meets by chance is told apart below
    lf, p = frag[at], where[at]
    lkey = key[begin[lf] + p] + of[lf].astype(np.uint64) * apart
    at = (begin[:, None] + np.arange(k + 1) * block).ravel()
    rf, q = frag[at], where[at]
    rkey = key[begin[rf] + q] + of[rf].astype(np.uint64) * apart
    order = np.argsort(rkey, kind="stable")
    rf, q, rkey = rf[order], q[order], rkey[order]
    lo = np.searchsorted(rkey, lkey, "left")
    hit = np.flatnonzero(rkey[np.minimum(lo, len(rkey) - 1)] == lkey)
    lf, p, lo = lf[hit], p[hit], lo[hit]
    many = np.searchsorted(rkey, lkey[hit], "right") - lo
    # bytes at i .. i + n and j .. j + n are equal only if (sums[i + n] - sums[i]) * power[j] and the other way round are
    power = np.full(len(raw) + 1, 0xD6E8FEB86659FD93, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    best: list[np.ndarray] = []

    def alike(a, b, n):
        """Whether bytes are equal, one by one."""
        ok = np.ones(len(a), bool)
        for z in _portions(n, RAW):
            i, own = _runs(begin[a[z]] + size[a[z]] - n[z], n[z])
            j, _ = _runs(begin[b[z]], n[z])
            ok[z.start + own[raw[i] != raw[j]]] = False
        return ok

    def chosen(a, b, n):
        """(a, b, n, exact) of the best of each pair among the candidates that hold."""
        i, j = begin[a] + size[a] - n, begin[b]
        exact = (sums[i + n] - sums[i]) * power[j] == (sums[j + n] - sums[j]) * power[i]
        sure = np.zeros(len(a), bool)
        while True:
            top = _longest(a, b, n, exact)
            doubt = top[exact[top] & ~sure[top]]
            good = alike(a[doubt], b[doubt], n[doubt])
            sure[doubt] = True
            if good.all():
                break
            exact[doubt[~good]] = False  # the sums met by chance
        if not k:
            top = top[exact[top]]
            return a[top], b[top], n[top], exact[top]
        # pairs without an exact overlap: count the differences of all their lengths
        pair = np.zeros(len(a), bool)
        pair[top[exact[top]]] = True
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        has = np.logical_or.reduceat(pair[order], np.flatnonzero(new))
        rest = np.sort(order[~np.repeat(has, np.diff(np.append(np.flatnonzero(new), len(order))))])
        near = np.zeros(len(a), bool)
        for z in _portions(n[rest], RAW):
            r = rest[z]
            x, own = _runs(begin[a[r]] + size[a[r]] - n[r], n[r])
            y, _ = _runs(begin[b[r]], n[r])
            near[r] = np.bincount(own[raw[x] != raw[y]], minlength=len(r)) <= k
        held = np.flatnonzero(near)
        top = np.concatenate([top[exact[top]], held[_longest(a[held], b[held], n[held], exact[held])]])
        return a[top], b[top], n[top], exact[top]

    for z in _portions(many, SEEDS):
        j, own = _runs(lo[z], many[z])
        a, b = lf[z][own], rf[j]
        n = size[a] - p[z][own] + q[j]
        ok = (of[a] == of[b]) & (a != b) & (n >= least) & (n <= np.minimum(size[a], size[b]))
        if ok.any():
            best.append(np.stack(chosen(a[ok], b[ok], n[ok])))
    if not best:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    a, b, n, exact = np.concatenate(best, axis=1)
    top = _longest(a, b, n, exact.astype(bool))
    return a[top], b[top], n[top], exact[top].astype(bool)


def differences(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(mismatches, mismatch_details) of the edges that overlaps() gives."""
    near = np.flatnonzero(~exact)
    at, own, left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [raw[:0]], [raw[:0]]
    for z in _portions(n[near], RAW):
        e = near[z]
        i, o = _runs(begin[a[e]] + size[a[e]] - n[e], n[e])
        j, _ = _runs(begin[b[e]], n[e])
        d = np.flatnonzero(raw[i] != raw[j])
        at.append(j[d] - begin[b[e]][o[d]])
        own.append(e[o[d]])
        left.append(raw[i[d]])
        right.append(raw[j[d]])
    miss = np.bincount(np.concatenate(own), minlength=len(a)).astype(np.int64)
    detail = pa.StructArray.from_arrays([pa.array(np.concatenate(at)), *(pa.array(np.concatenate(x).astype(np.int16)) for x in (left, right))], ["overlap_offset", "left_byte", "right_byte"])
    return miss, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(miss)]).astype(np.int32)), detail)


def _joiner(least: int, k: int):
    """Datasets (dataset_id, ids, parts) to edges, whole datasets side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.diff(batch["ids"].offsets.to_numpy())
            ids = batch["ids"].flatten().to_numpy(zero_copy_only=False)
            parts = batch["parts"].flatten().cast(pa.large_binary())
            edge = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
            every, last = np.frombuffer(parts.buffers()[2] or b"", np.uint8), np.cumsum(held)
            first = last - held
            for z in _portions(edge[last] - edge[first], RAW):
                u, v = first[z.start], last[z.stop - 1]
                begin, size = edge[u:v] - edge[u], np.diff(edge[u : v + 1])
                raw = every[edge[u] : edge[v]]
                a, b, n, exact = overlaps(raw, begin, size, np.repeat(np.arange(z.start, z.stop), held[z]), least, k)
                order = np.lexsort((b, a))
                a, b, n, exact = a[order], b[order], n[order], exact[order]
                miss, detail = differences(raw, begin, size, a, b, n, exact)
                row = np.repeat(np.arange(z.start, z.stop), held[z])[a]
                columns = [batch["dataset_id"].take(pa.array(row)), *map(pa.array, (ids[u:v][a], ids[u:v][b], n, n - miss, miss, exact)), detail]
                yield pa.RecordBatch.from_arrays(columns, _COLUMNS)

    return run


_COLUMNS = ["dataset_id", "src", "dst", "overlap", "matches", "mismatches", "exact", "mismatch_details"]


def gathered_edges(frags: DataFrame, least: int, k: int = 0) -> DataFrame:
    """The edges of datasets that fit in a task, each gathered there: fragments are moved once, seeds and pairs never."""
    kind = dict(frags.dtypes)["dataset_id"]
    d = frags.groupBy("dataset_id").agg(F.collect_list(F.col("node_id").cast("bigint")).alias("ids"), F.collect_list("data").alias("parts"))
    return d.mapInArrow(_joiner(least, k), f"dataset_id {kind}, src long, dst long, overlap long, matches long, mismatches long, exact boolean, mismatch_details array<struct<overlap_offset:bigint,left_byte:smallint,right_byte:smallint>>")


def indexed_edges(frags: DataFrame, least: int, k: int = 0) -> DataFrame:
    """The edges of exhaustive_edges() by a seed equi-join. Too small a least overlap for k + 1 blocks goes the exhaustive way.

    Edge: the longest exact overlap of at least `least` bytes, else the longest with at most k
    mismatches. A fragment has no edge to itself. Shorter fragments take no part.
    """
    if least < 1:
        raise ValueError("the least overlap has to be positive")
    if least < k + 1:
        return exhaustive_edges(frags, least, k)
    f = frags.where((F.length("data") >= least) & F.col("dataset_id").isNotNull()).select("dataset_id", "node_id", "data")
    # large datasets number at most the bytes of all over GATHER, so their ids are few
    large = F.broadcast(f.groupBy("dataset_id").agg(F.sum(F.length("data").cast("bigint")).alias("n")).where(F.col("n") > GATHER).select("dataset_id"))
    return gathered_edges(f.join(large, "dataset_id", "left_anti"), least, k).unionByName(shuffled_edges(f.join(large, "dataset_id", "left_semi"), least, k))


def shuffled_edges(f: DataFrame, least: int, k: int = 0) -> DataFrame:
    """The same edges where no dataset has to fit in a task: fragments (dataset_id, node_id, data) of at least `least` bytes, least > k."""
    kind = dict(f.dtypes)["dataset_id"]
    schema = f"dataset_id {kind}, node_id long, size int, key long, at int"
    seeds = lambda side, data: f.select("dataset_id", "node_id", F.length("data").alias("size"), data.alias("data")).mapInPandas(_seeds(least, k, side), schema)
    left = seeds(True, F.col("data")).select("dataset_id", "key", F.col("node_id").alias("src"), F.col("at").alias("p"), F.col("size").alias("nl"))
    right = seeds(False, F.substring("data", 1, least)).select("dataset_id", "key", F.col("node_id").alias("dst"), F.col("at").alias("q"), F.col("size").alias("nr"))
    near = left.join(right, ["dataset_id", "key"]).where("src <> dst").withColumn("n", F.col("nl") - F.col("p") + F.col("q"))
    near = near.where((F.col("n") >= least) & (F.col("n") <= F.least("nl", "nr")))
    # lengths of a pair number at most the bytes of a fragment
    pairs = near.groupBy("dataset_id", "src", "dst").agg(F.collect_set("n").alias("ns"))
    pairs = pairs.join(f.select("dataset_id", F.col("node_id").alias("src"), F.col("data").alias("l")), ["dataset_id", "src"])
    pairs = pairs.join(f.select("dataset_id", F.col("node_id").alias("dst"), F.col("data").alias("r")), ["dataset_id", "dst"])
    return _edges(pairs, k)
