"""Connected components of a link table, distributed, by rounds of random-priority contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.session import cut_lineage

#: Links that one task finishes; more are contracted first.
ONE_TASK = 15_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All links that are left to (u, to): each node and one member of its component."""
    held = [(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)) for pdf in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"u": nodes, "to": nodes[root]})


def components(links: DataFrame, rounds: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links between long ids -> (node, root): one root, some member, per component.

    Each round every node moves to the neighbour (itself included) of the smallest random
    priority, links are renamed to the nodes they moved to, and loops and repeats go. The
    share of nodes that stays shrinks geometrically in expectation whatever the shape, so
    chains end in logarithmically many rounds. Minima are pre-aggregated before the shuffle
    (a hub costs one row per task) and the renaming joins are plain equi-joins that adaptive
    execution can split at a hub. Every round is cut by a reliable checkpoint. At most one_task
    links are finished by one task at once, which changes no component. Nodes without a link to
    another node get no row. Nulls are ignored; an empty table gives an empty one.
    """
    e = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = cut_lineage(e.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for k in range(rounds):
        left = e.count()
        if not left:
            return found
        if left <= one_task:
            last = e.coalesce(1).mapInPandas(_finish, "u long, to long").select(F.col("u").alias("root"), "to")
            return cut_lineage(found.join(last, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("p"), F.col(c).alias("v"))
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), rank("b").alias("m")), F.struct(F.col("b").alias("u"), rank("a").alias("m")))).alias("x")).select("x.*")
        best = both.groupBy("u").agg(F.min("m").alias("m"))
        move = cut_lineage(best.select("u", F.least(F.col("m"), F.struct(F.xxhash64(F.col("u"), F.lit(k)).alias("p"), F.col("u").alias("v")))["v"].alias("to")))
        to_a, to_b = move.select(F.col("u").alias("a"), F.col("to").alias("x")), move.select(F.col("u").alias("b"), F.col("to").alias("y"))
        e = e.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = cut_lineage(e)
        found = found.join(move.select(F.col("u").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        found = cut_lineage(found)
    raise RuntimeError("components did not settle")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of the links (a[i], b[i]) between 0 .. n - 1 that span all of them without a ring."""
    root, at, out = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(at):
        u, v = root[a[at]], root[b[at]]
        apart = u != v
        at, u, v = at[apart], u[apart], v[apart]
        if not len(at):
            break
        # one link for each larger root, to its smallest partner: never closes a ring
        hi, lo = np.maximum(u, v), np.minimum(u, v)
        order = np.lexsort((lo, hi))
        pick = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
        out.append(at[pick])
        root[hi[pick]] = lo[pick]
        while (root[root] != root).any():
            root = root[root]
    return np.concatenate(out)
