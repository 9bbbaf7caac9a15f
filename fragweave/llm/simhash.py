"""SimHash near-duplicates: 64-bit fingerprints, exact tiled comparison, connected groups.

Fingerprints within 3 bits agree on at least one of four 16-bit blocks, so comparing inside
the groups that share a block loses no pair. Inside a group the distinct fingerprints are
sorted by population count and laid out in tiles, small groups side by side; a pair of tiles is
compared with numpy exclusive-or and bit counts unless their population counts differ by more
than the radius everywhere. A group too large for one task is split into chunks, and every pair of chunks is
a task of its own. Copies share a fingerprint and are one row long before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragweave.llm.common import chunks, folded_words
from fragweave.llm.components import components
from fragweave.session import cut_lineage

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints that one unit of comparison holds from each of its two chunks.
CHUNK = 8192
#: Rows of a tile; members of small groups that are laid out together.
TILE, PACK = 256, 2048


def hashes(words: list[bytes], k: int = SHINGLE) -> list[int]:
    """XXH64 of every k-word shingle, repeats included; fewer words: of the whole sequence; none: none."""
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist())]


def fingerprints(texts: list[str]) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is 1 if set in over half of the shingle hashes."""
    per = [hashes(folded_words(t)) for t in texts]
    counts = np.fromiter(map(len, per), np.int64, len(per))
    out = np.zeros(len(per), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        flat = np.fromiter((x for p in per for x in p), np.uint64, int(counts.sum()))
        at = np.concatenate([[0], np.cumsum(counts[some])])
        # bits of a bounded run of documents at a time: a byte for each bit of each shingle
        first = 0
        while first < len(some):
            last = max(first + 1, int(np.searchsorted(at, at[first] + 400_000, "right")) - 1)
            bits = np.unpackbits(flat[at[first] : at[last]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, at[first:last] - at[first], axis=0, dtype=np.int64)
            major = (2 * ones > counts[some[first:last], None]).astype(np.uint8)
            out[some[first:last]] = np.packbits(major, axis=1).view(">u8").ravel()
            first = last
    return out.view(np.int64)


@F.pandas_udf(T.LongType())
def fingerprint_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fingerprints() over a text column; null text has the fingerprint zero."""
    for s in batches:
        parts = [fingerprints(c) for c in chunks(s)]
        yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def tiles(pa: np.ndarray, pb: np.ndarray, own: bool, radius: int) -> Iterator[tuple[int, int, bool]]:
    """(first row, first column, whether it has to be compared) of every pair of tiles; own: of the upper triangle only.

    pa, pb: ascending population counts. Fingerprints within the radius differ by no more in their
    population counts, so a pair of tiles that differ by more everywhere holds no link.
    """
    for i in range(0, len(pa), TILE):
        low, high = pa[i], pa[min(len(pa), i + TILE) - 1]
        for j in range(i if own else 0, len(pb), TILE):
            yield i, j, bool(pb[j] - high <= radius and low - pb[min(len(pb), j + TILE) - 1] <= radius)


def compare(a: np.ndarray, b: np.ndarray | None, radius: int, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among a, or between a and b if b is given.

    Both hold distinct unsigned fingerprints. Tiles in population-count order; tile pairs too
    far apart are skipped. Links that join what earlier tile pairs have already joined are left
    out, so a dense group gives as many rows as members and not their square. tally: the numbers
    of tile pairs compared and skipped are added to it.
    """
    own = b is None
    tally = [0, 0] if tally is None else tally
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    b = a if own else b[np.argsort(np.bitwise_count(b), kind="stable")]
    root = np.arange(len(a) + (0 if own else len(b)))
    shift = 0 if own else len(a)
    left, right = [], []
    for i, j, near in tiles(np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int), own, radius):
        tally[not near] += 1
        if not near:
            continue
        r, c = np.nonzero(np.bitwise_count(a[i : i + TILE, None] ^ b[None, j : j + TILE]) <= radius)
        if own and i == j:
            r, c = r[r < c], c[r < c]
        r, c = r + i, c + j + shift
        while len(r):
            u, v = root[r], root[c]
            apart = u != v
            r, c, u, v = r[apart], c[apart], u[apart], v[apart]
            if not len(r):
                break
            # one link for each larger root, to its smallest partner: never closes a ring
            hi, lo = np.maximum(u, v), np.minimum(u, v)
            order = np.lexsort((lo, hi))
            pick = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
            left.append(a[r[pick]])
            right.append(b[c[pick] - shift])
            root[hi[pick]] = lo[pick]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _packs(groups: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Groups laid side by side, whole ones, in packs of at most PACK members or of one group: what tiles are cut from.

    Links between groups of a pack are links too, so they needn't be told apart.
    """
    held, size = [], 0
    for g in groups:
        if held and size + len(g) > PACK:
            yield np.unique(np.concatenate(held))
            held, size = [], 0
        held.append(g)
        size += len(g)
    if held:
        yield np.unique(np.concatenate(held))


def _linker(radius: int, tally):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = [0, 0]
        for pdf in batches:
            members = [(np.asarray(x, np.int64).view(np.uint64), np.asarray(y, np.int64).view(np.uint64)) for x, y in zip(pdf["own"], pdf["other"])]
            parts = [compare(x, y, radius, done) for x, y in members if len(y)]
            parts += [compare(x, None, radius, done) for x in _packs(x for x, y in members if not len(y))]
            if parts:
                yield pd.DataFrame({"a": np.concatenate([p[0] for p in parts]).view(np.int64), "b": np.concatenate([p[1] for p in parts]).view(np.int64)})
        for counter, n in zip(tally or (), done):
            counter.add(n)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, tally: tuple | None = None) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b): links that span all pairs within the radius.

    radius must be below the four blocks. Members of a block's group are dealt to
    ceil(n / chunk) chunks by a hash; a unit is one chunk or a pair of chunks, and holds at most
    about two chunks of fingerprints however hot its block is. Every unit goes through the tiles;
    tally: two accumulators that the numbers of tile pairs compared and skipped are added to.
    """
    if radius > 3:
        raise ValueError("four blocks guarantee a shared block up to a radius of 3")
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    rows = fps.select("fp", F.explode(F.array(*[F.lit(k * 65536) + block(k) for k in range(4)])).alias("block"))
    size = rows.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block", F.ceil(F.col("n") / chunk).cast("int").alias("s"))
    # at most 4 * 65536 rows of 12 bytes, whatever the input
    rows = rows.join(F.broadcast(size), "block").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    units = rows.select("block", F.least("c", "p").alias("x"), F.greatest("c", "p").alias("y"), F.struct((F.col("c") == F.least("c", "p")).alias("first"), "fp").alias("m"))
    units = units.groupBy("block", "x", "y").agg(F.collect_list("m").alias("m"))
    split = lambda keep: F.transform(F.filter("m", lambda z: z["first"] if keep else ~z["first"]), lambda z: z["fp"])
    units = units.select(split(True).alias("own"), split(False).alias("other"))
    return units.mapInPandas(_linker(radius, tally), "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", tally: tuple | None = None) -> DataFrame:
    """documents -> (doc_id, fp, component_id): fingerprints and groups of near copies, a row per document.

    component_id is the smallest id reachable over links, the own id included. Null and empty
    texts have the fingerprint zero and link like any other. Repeated ids keep their rows; a null id
    links like any other and is no group's smallest unless the group has none else. Very long
    texts are fingerprinted whole. Further columns of the input, whatever their names, play no part. No documents: no rows.
    """
    fps = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), fingerprint_of(F.col(text_col)).alias("fp")))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(least.select("fp"), radius, tally=tally))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut_lineage(named)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str) -> "F.Column":
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
