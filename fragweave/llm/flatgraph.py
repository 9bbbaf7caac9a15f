"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors go to the shards of their nearest clusters (several, so shards overlap); each shard
builds a robust-pruned neighbour graph; a vector's adjacency lists from all its shards are
united. Search runs per shard over the united lists: greedily from the shard's medoid, then
range-expanding, from every vector in range to its neighbours, until nothing new is in range.
Found pairs are verified in double precision, and each shard is checked for pairs that the search
missed. An audit searches for probes, vectors made near to sampled ones, and compares with brute
force over all vectors; too low a recall raises the overlap and repeats, and is an error in the end.

Equal vectors are one weighted node from the start. Clusters of more than a few chunks are clustered
again, as often as needed, so shards stay of one size and a vector's copies grow with the depth
only. What can't be divided is a dense group: its core, the vectors within half the radius of
its centre, which all link with each other, is counted in closed form, and the rest is compared
with all of it in chunks. A pair belongs to the first by name of the clusters that both its
vectors are in, and is counted there only; no pair leaves its task, but for a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.llm.components import components, spanning
from fragweave.session import cut_lineage

THRESHOLD = 0.95
#: Vectors that are looked at in range expansion even if they don't link.
SLACK = 0.02
#: Expected vectors of a cluster, most vectors of a chunk; most vectors that clusters, and those within a cluster, are fitted on.
CLUSTER, CHUNK, SAMPLE, SUB_SAMPLE = 1500, 3000, 16384, 4096
#: Chunks of a cluster from which on it is divided; smaller ones are compared chunk by chunk, which bounds their copies.
#: Vectors of a large cluster that one task deals to the clusters within.
UNDIVIDED, PART = 4, 20_000
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 24
#: Edges of a node to vectors in range beyond its nearest candidates, so that dense groups in range of each other are connected.
FAR_EDGES = 8
#: Clusters of a vector; probes of the audit and their cosine to the vector that they are made from; the
#: recall that raises the overlap if not met, and the least that is no error.
OVERLAP, AUDIT, NEAR, RECALL, LEAST = 3, 256, 0.965, 0.97, 0.9


def unit(v: np.ndarray) -> np.ndarray:
    """Rows brought to length one."""
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fit_centers(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over unit rows, from evenly spaced rows of the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.sqrt((s * s).sum(1))
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def build(x: np.ndarray, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """Adjacency lists of a robust-pruned graph over unit rows, with reverse edges, nearest neighbours and some far ones in range."""
    m = len(x)
    if m < 2:
        return [np.zeros(0, np.int64) for _ in range(m)]
    x = x.astype(np.float32)
    k = min(CANDIDATES, m - 1)
    out, into = [], []
    for i in range(0, m, 512):
        rows = np.arange(i, min(m, i + 512))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -9
        cand = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < m - 1 else np.argsort(-s, axis=1)[:, :k]
        cs = np.take_along_axis(s, cand, 1)
        order = np.argsort(-cs, axis=1, kind="stable")
        cand, cs = np.take_along_axis(cand, order, 1), np.take_along_axis(cs, order, 1)
        for i in np.flatnonzero((s >= threshold).sum(1) > k):
            rest = np.flatnonzero(s[i] >= threshold)
            rest = rest[np.argsort(-s[i, rest], kind="stable")][k:]
            rest = rest[np.unique(np.linspace(0, len(rest) - 1, FAR_EDGES).astype(int))]
            out.append(np.full(len(rest), rows[i]))
            into.append(rest)
        far = np.maximum(2 - 2 * cs, 0)
        alive = np.ones(cand.shape, bool)
        r = np.arange(len(rows))
        # the nearest few in any case, so that dense groups stay connected
        for j in range(min(3, k)):
            out.append(rows)
            into.append(cand[:, j])
        for _ in range(min(DEGREE, k)):
            first = alive.argmax(1)
            ok = alive[r, first]
            if not ok.any():
                break
            pick = cand[r, first]
            out.append(rows[ok])
            into.append(pick[ok])
            between = np.maximum(2 - 2 * np.einsum("id,ikd->ik", x[pick], x[cand]), 0)
            alive &= ~(ALPHA * ALPHA * between <= far)
            alive[r, first] = False
    a, b = np.concatenate(out), np.concatenate(into)
    code = np.unique(np.concatenate([a * m + b, b * m + a]))
    return np.split(code % m, np.searchsorted(code // m, np.arange(1, m)))


def search(nodes: np.ndarray, near: list[np.ndarray], queries: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of unit rows with a cosine of at least the threshold, found over the graph.

    own: each query's row among the nodes, or -1.
    """
    m, q = len(nodes), len(queries)
    if not m or not q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = nodes.astype(np.float32), queries.astype(np.float32)
    width = 2 * DEGREE
    pad = np.full((m, width), -1, np.int64)
    for i, n in enumerate(near):
        # an even choice of long lists for the greedy phase; expansion below uses all
        n = n if len(n) <= width else n[np.linspace(0, len(n) - 1, width).astype(int)]
        pad[i, : len(n)] = n
    medoid = int((x @ x.mean(0)).argmax())
    rows = np.arange(q)
    seen = np.zeros((q, m), bool)
    ids = np.full((q, BEAM), -1, np.int64)
    sims = np.full((q, BEAM), -9, np.float32)
    done = np.ones((q, BEAM), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = medoid, y @ x[medoid], False
    seen[:, medoid] = True
    active = rows
    while len(active):
        s = np.where(done[active], -9, sims[active])
        j = s.argmax(1)
        active, j = active[s[np.arange(len(active)), j] > -9], j[s[np.arange(len(active)), j] > -9]
        if not len(active):
            break
        done[active, j] = True
        nb = pad[ids[active, j]]
        fresh = (nb >= 0) & ~seen[active[:, None], np.maximum(nb, 0)]
        np.logical_or.at(seen, (active[:, None], np.maximum(nb, 0)), nb >= 0)
        d = np.where(fresh, np.einsum("qd,qrd->qr", y[active], x[np.maximum(nb, 0)]), -9)
        all_ids, all_sims = np.concatenate([ids[active], nb], 1), np.concatenate([sims[active], d], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        top = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
        ids[active], sims[active], done[active] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sims, all_done))
    # range expansion: pairs in range, breadth first over whole adjacency lists
    sizes = np.fromiter(map(len, near), np.int64, m)
    begin, flat = np.cumsum(sizes) - sizes, np.concatenate(near) if m else np.zeros(0, np.int64)
    hit = np.zeros((q, m), bool)
    r, c = np.nonzero(sims >= threshold - SLACK)
    fq, fn = np.concatenate([r, rows[own >= 0]]), np.concatenate([ids[r, c], own[own >= 0]])
    hit[fq, fn] = True
    fq, fn = np.nonzero(hit)
    tried = hit.copy()
    while len(fq):
        nq, nn = [], []
        for i in range(0, len(fq), 20_000):
            a, b = fq[i : i + 20_000], fn[i : i + 20_000]
            n = sizes[b]
            eq = np.repeat(a, n)
            en = flat[np.repeat(begin[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            new = ~tried[eq, en]
            code = np.unique(eq[new] * m + en[new])
            eq, en = code // m, code % m
            tried[eq, en] = True
            for k in range(0, len(eq), 50_000):
                u, v = eq[k : k + 50_000], en[k : k + 50_000]
                ok = np.einsum("id,id->i", y[u], x[v]) >= threshold - SLACK
                nq.append(u[ok])
                nn.append(v[ok])
        fq, fn = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (nq, nn))
        hit[fq, fn] = True
    r, c = np.nonzero(hit)
    keep = [np.einsum("id,id->i", queries[r[i : i + 50_000]], nodes[c[i : i + 50_000]]) >= threshold for i in range(0, len(r), 50_000)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return r[keep], c[keep]


def exact(nodes: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of unit rows with a cosine of at least the threshold, all compared."""
    r, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(queries) if len(nodes) else 0, 512):
        a, b = np.nonzero(queries[i : i + 512] @ nodes.T >= threshold)
        r.append(a + i)
        c.append(b)
    return np.concatenate(r), np.concatenate(c)


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in column]) if len(column) else np.zeros((0, 1))


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(vec_id, embedding) -> the ids with the unit vector as bytes; vectors that can't link are left out."""
    for pdf in batches:
        ids, vs = [], []
        for i, e in zip(pdf["vec_id"], pdf["embedding"]):
            if e is None or not len(e):
                continue
            v = np.array([np.nan if z is None else z for z in e] if getattr(e, "dtype", object) == object else e, np.float64)
            top = np.abs(v).max()
            if not np.isfinite(v).all() or top == 0:
                continue
            ids.append(i)
            vs.append(unit((v / top)[None])[0].astype("<f8").tobytes())
        yield pd.DataFrame({"vec_id": pd.Series(ids, dtype="int64"), "v": vs})


def _nearest(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    k = min(k, len(centers))
    out = [np.argsort(-(x[i : i + 4096] @ centers.T), axis=1, kind="stable")[:, :k] for i in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


_MEMBER = "id long, n long, v binary, probe boolean, cluster string, home boolean, done boolean, core boolean"


def _members(pdf: pd.DataFrame, names: list[list[str]], home, done: bool, core) -> pd.DataFrame:
    """A row for each vector and each of its clusters; the first is its home, if what they divide is."""
    times = np.fromiter(map(len, names), np.int64, len(names))
    out = pdf[["id", "n", "v", "probe"]].iloc[np.repeat(np.arange(len(pdf)), times)].reset_index(drop=True)
    first = np.concatenate([np.arange(t) == 0 for t in times]) if len(times) else np.zeros(0, bool)
    return out.assign(cluster=[x for n in names for x in n], home=first & np.repeat(home, times), done=done, core=np.repeat(core, times))


def _assigner(centers: dict[int, np.ndarray], overlap: int):
    """Vectors to the clusters of their nearest centres, of their own length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names: list = [None] * len(pdf)
            dims = pdf["v"].map(len).to_numpy() // 8
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i, row in zip(at, _nearest(_matrix(pdf["v"].iloc[at]), centers[int(dim)], overlap)):
                    names[i] = [f"{dim}:{j}" for j in row]
            yield _members(pdf, names, np.ones(len(pdf), bool), False, np.zeros(len(pdf), bool))

    return run


def divide(x: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Centres within a cluster: k at most, no two within the threshold of each other, so that a dense group has one."""
    c = fit_centers(x, max(1, k))
    keep: list[int] = []
    for i in range(len(c)):
        if not keep or (c[keep] @ c[i]).max() < threshold:
            keep.append(i)
    return c[keep]


def _divider(cluster: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("id")["v"])
        c = divide(x, int(min(-(-int(pdf["m"].iloc[0]) // cluster), max(1, len(x) // 8))), threshold)
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "m": [pdf["m"].iloc[0]], "centers": [c.astype("<f8").tobytes()]})

    return run


def _dealer(overlap: int, threshold: float):
    """A part of a large cluster to the clusters within. One that can't be divided is done; if it is one dense group, its core is marked."""
    half = np.sqrt((1 + threshold) / 2) + 1e-9  # cosine of half the angle: what is nearer than that to one point is in range of each other

    def run(key: tuple, pdf: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["id", "n", "v", "probe", "cluster", "home", "done", "core"])
        x, name = _matrix(pdf["v"]), pdf["cluster"].iloc[0]
        c = np.frombuffer(fitted["centers"].iloc[0], "<f8").reshape(-1, x.shape[1]) if len(fitted) else np.zeros((0, x.shape[1]))
        home = pdf["home"].to_numpy(bool)
        if len(c) < 2:
            core = (x @ c[0] >= half) & home & ~pdf["probe"].to_numpy(bool) if len(c) else np.zeros(len(x), bool)
            return _members(pdf, [[name]] * len(pdf), home, True, core)
        if len(c) < 2 * overlap:  # the clusters within would be hardly smaller
            return _members(pdf, [[name]] * len(pdf), home, True, np.zeros(len(x), bool))
        return _members(pdf, [[f"{name}.{j}" for j in row] for row in _nearest(x, c, overlap)], home, False, np.zeros(len(x), bool))

    return run


def shards(vectors: DataFrame, centers: dict[int, np.ndarray], overlap: int, threshold: float, chunk: int, cluster: int) -> DataFrame:
    """(id, n, v, probe) -> a row for each vector and each of its shards: _MEMBER.

    Clusters of more than UNDIVIDED chunks are divided by centres fitted on a bounded sample of each,
    until all are smaller or can't be divided. Where a round leaves the largest as it was, that is the end.
    """
    members = cut_lineage(vectors.mapInPandas(_assigner(centers, overlap), _MEMBER))
    spread, last = 1 << 30, 1 << 62
    while True:
        size = members.where("not done").groupBy("cluster").agg(F.count("*").alias("m")).where(F.col("m") > UNDIVIDED * chunk)
        most = size.agg(F.max("m").alias("m")).first().m or 0
        if not most:
            return members
        stuck, last = most >= last, most
        big = members.join(size, "cluster", "left").withColumn("m", F.when(~F.col("done"), F.col("m")))
        rest, big = big.where("m is null").drop("m"), big.where("m is not null")
        if stuck:
            big = big.withColumn("done", F.lit(True)).drop("m")
            return cut_lineage(rest.unionByName(big))
        few = big.where("not probe").where(F.pmod(F.xxhash64("id"), F.lit(spread)) < F.least(F.lit(1.0), SUB_SAMPLE / F.col("m")) * spread)
        fitted = few.select("id", "v", "cluster", "m").groupBy("cluster").applyInPandas(_divider(cluster, threshold), "cluster string, m long, centers binary")
        parts = F.ceil(F.col("m") / PART).cast("int")
        fitted = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        big = big.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int"))
        dealt = big.groupBy("cluster", "part").cogroup(fitted.groupBy("cluster", "part")).applyInPandas(_dealer(max(2, overlap - 1), threshold), _MEMBER)
        members = cut_lineage(rest.unionByName(dealt))


def _builder(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": ids, "adj": [ids[n].tolist() for n in build(_matrix(pdf["v"]), threshold)]})

    return run


def _first_common(names: list[list[str]], a: np.ndarray, others: list[list[str]], b: np.ndarray, cluster: str) -> np.ndarray:
    """Whether no cluster before `cluster` by name holds both vectors of a pair (names[a[i]], others[b[i]])."""
    code = {x: i for i, x in enumerate(sorted({x for n in (*names, *others) for x in n if x < cluster}))}
    wide = max((sum(x in code for x in n) for n in (*names, *others)), default=0)
    if not wide:
        return np.ones(len(a), bool)

    def table(lists: list[list[str]], none: int) -> np.ndarray:
        out = np.full((len(lists), wide), none)
        for i, n in enumerate(lists):
            c = [code[x] for x in n if x in code]
            out[i, : len(c)] = c
        return out

    left, right = table(names, -1), table(others, -2)
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 200_000):
        at = slice(i, i + 200_000)
        for k in range(wide):
            out[at] &= ~(left[a[at], k, None] == right[b[at]]).any(1)
    return out


_FOUND = "id long, links long, a long, b long, probe long, hit long, found long, there long"


def _searcher(threshold: float):
    """One shard, or a pair of chunks of one: counted links, a spanning forest, what probes hit, found and existing pairs."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cluster, same = key[0], key[1] == key[2]
        probe, node = pdf["probe"].to_numpy(bool), pdf["is_node"].to_numpy(bool)
        n, q = pdf[node & ~probe], pdf[pdf["is_query"].to_numpy(bool) & ~probe]
        node_ids, nodes = n["id"].to_numpy(np.int64), _matrix(n["v"])
        if same:
            q = n
            made = pdf[probe]
            at = pd.Series(np.arange(len(n)), index=node_ids)
            near = [np.unique(x[~np.isnan(x)]).astype(np.int64) for x in (at.reindex(x if x is not None else []).to_numpy(float) for x in n["adj"])]
            own = np.concatenate([np.arange(len(n)), np.full(len(made), -1)])
            r, c = search(nodes, near, np.concatenate([nodes, _matrix(made["v"])]) if len(made) else nodes, own, threshold)
            hit = r >= len(n)
            probes = made["id"].to_numpy(np.int64)[r[hit] - len(n)], node_ids[c[hit]]
            # a pair is one row, whichever of its vectors found the other; then the check for those that neither did
            pair = lambda r, c: np.unique(np.minimum(r, c)[r != c] * len(n) + np.maximum(r, c)[r != c])
            found, there = pair(r[~hit], c[~hit]), pair(*exact(nodes, nodes, threshold))
            audit = int(np.isin(found, there).sum()), len(there)
            r, c = there // max(1, len(n)), there % max(1, len(n))
        else:
            r, c = exact(nodes, _matrix(q["v"]), threshold)
            # a probe is in one of the two chunks and is compared with the other
            ids, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for made, other in ((pdf[probe & node], q), (pdf[probe & ~node], n)):
                a, b = exact(_matrix(other["v"]), _matrix(made["v"]), threshold)
                ids.append(made["id"].to_numpy(np.int64)[a])
                to.append(other["id"].to_numpy(np.int64)[b])
            probes, audit = (np.concatenate(ids), np.concatenate(to)), (0, 0)
        query_ids = q["id"].to_numpy(np.int64)
        of = {x: i for i, x in enumerate({*q["core"].dropna(), *n["core"].dropna()})}
        core_q, core_n = (np.array([of.get(x, -1 - k) for x in d["core"]], np.int64) for k, d in ((0, q), (1, n)))
        mine = (core_q[r] != core_n[c]) & _first_common(list(q["near"]), r, list(n["near"]), c, cluster)
        r, c = r[mine], c[mine]
        wq, wn = q["n"].to_numpy(np.int64), n["n"].to_numpy(np.int64)
        count = pd.DataFrame({"id": np.concatenate([query_ids[r], node_ids[c]]), "links": np.concatenate([wn[c], wq[r]])}).groupby("id", as_index=False).sum()
        pick = spanning(r, c if same else c + len(q), len(q) + len(n))
        forest = pd.DataFrame({"a": query_ids[r[pick]], "b": node_ids[c[pick]]})
        out = [count, forest, pd.DataFrame({"probe": probes[0], "hit": probes[1]}), pd.DataFrame({"found": [audit[0]], "there": [audit[1]]})]
        return pd.concat(out, ignore_index=True).reindex(columns=["id", "links", "a", "b", "probe", "hit", "found", "there"]).astype("Int64")

    return run


def _probes(few: list, threshold: float) -> list[tuple[int, bytes]]:
    """(number, vector): made from sampled vectors, at a known cosine, so that each has a partner."""
    out = []
    for k, r in enumerate(few[:AUDIT]):
        x = np.frombuffer(r.v, "<f8")
        d = np.random.default_rng(k).standard_normal(len(x))
        d -= (d @ x) * x
        size = np.sqrt(d @ d)
        near = max(NEAR, (1 + threshold) / 2)
        y = near * x + np.sqrt(1 - near * near) * d / size if size > 1e-6 else x
        out.append((k, unit(y[None])[0].astype("<f8").tobytes()))
    return out


def _truth(probes: list[tuple[int, bytes]], threshold: float):
    """Brute force: how many of a batch of all vectors are in range of each probe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[int, list] = {}
        for k, v in probes:
            by.setdefault(len(v) // 8, []).append((k, v))
        total = np.zeros(len(probes), np.int64)
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy() // 8
            for dim, some in by.items():
                x, at = _matrix([v for _, v in some]), np.flatnonzero(dims == dim)
                for i in range(0, len(at), 4096):
                    total[[k for k, _ in some]] += (x @ _matrix(pdf["v"].iloc[at[i : i + 4096]]).T >= threshold).sum(1)
        yield pd.DataFrame({"probe": np.arange(len(probes)), "there": total})

    return run


def _one_pass(vectors: DataFrame, centers: dict[int, np.ndarray], overlap: int, threshold: float, chunk: int, cluster: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Build, union and search with a given overlap -> (rows of _FOUND, (id, core), members)."""
    member = shards(vectors, centers, overlap, threshold, chunk, cluster)
    # what is joined below are numbers and names; vectors come in once for each of the two groupings
    data, slim = vectors.select("id", "probe", "n", "v"), member.drop("n", "v")
    of = member.groupBy("id", "probe").agg(F.collect_list("cluster").alias("near"), F.max(F.when(F.col("core"), F.col("cluster"))).alias("core"))
    # a dense cluster's chunks: those of its core first
    own = F.coalesce(F.col("core"), F.lit(False)) & F.col("home")
    size = member.groupBy("cluster").agg(F.ceil(F.count_if(own) / chunk).cast("int").alias("sa"), F.ceil(F.count_if(~own) / chunk).cast("int").alias("sb"), F.count("*").alias("m"))
    size = size.withColumn("sa", F.when(F.col("m") > chunk, F.col("sa")).otherwise(0)).withColumn("sb", F.when(F.col("m") > chunk, F.col("sb")).otherwise(1)).drop("m")
    h = F.xxhash64("id")
    row = slim.join(size, "cluster").withColumn("c", F.when(own & (F.col("sa") > 0), F.pmod(h, F.greatest("sa", F.lit(1)))).otherwise(F.col("sa") + F.pmod(h, F.greatest("sb", F.lit(1)))).cast("int"))
    row = row.drop("core").join(of, ["id", "probe"])
    adj = row.where("not probe and c >= sa").join(data, ["id", "probe"]).groupBy("cluster", "c").applyInPandas(_builder(threshold), "id long, adj array<long>")
    united = adj.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj"))
    row = row.join(united, "id", "left")
    # a task for each chunk and each pair of chunks, but for pairs within the core; in a pair, those of the first are nodes, those of the second queries
    row = row.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("sa") + F.col("sb") - 1))).where("c >= sa or p >= sa")
    row = row.withColumns({"i": F.least("c", "p"), "j": F.greatest("c", "p"), "is_node": (F.col("c") <= F.col("p")), "is_query": (F.col("c") >= F.col("p"))})
    row = row.select("cluster", "i", "j", "is_node", "is_query", "id", "probe", "near", "core", F.when(F.col("i") == F.col("j"), F.col("adj")).alias("adj"))
    got = cut_lineage(row.join(data, ["id", "probe"]).groupBy("cluster", "i", "j").applyInPandas(_searcher(threshold), _FOUND))
    return got, of.where("not probe and core is not null").select("id", "core"), member


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK, cluster: int = CLUSTER, overlap: int = OVERLAP, report: dict | None = None) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row per row.

    Cosine in double precision. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, nor do vectors of different lengths. Equal vectors link. An id
    on several rows is several vectors for the counts; rows with a null id link with nothing. An
    empty table gives an empty one. If the audit's recall stays below RECALL, the overlap is
    doubled, at most to all clusters; below LEAST then is an error. report, if given, gets recall
    (probes found of those in range, over all vectors), shard_recall (pairs found by the search of
    those in a shard; what it missed is added), overlap and copies (shards a vector is in).
    """
    unit_rows = cut_lineage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").mapInPandas(_prepare, "vec_id long, v binary"))
    nodes = unit_rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    # numbers of their own, since an id may be on several different vectors; the checkpoint fixes them
    nodes = cut_lineage(nodes.select(F.monotonically_increasing_id().alias("id"), "first", "n", "v"))
    total = nodes.count()
    few = nodes.select("id", "v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    centers: dict[int, np.ndarray] = {}
    for dim in sorted({len(r.v) // 8 for r in few}):
        x = _matrix([r.v for r in few if len(r.v) == 8 * dim])
        centers[dim] = fit_centers(x, int(max(1, min(-(-total // cluster), len(x) // 8))))
    if few:
        others = [r.d for r in nodes.select((F.length("v") / 8).cast("int").alias("d")).distinct().collect() if r.d not in centers]
        centers |= {d: unit(np.ones((1, d))) for d in others}
    probes = _probes(few, threshold)
    in_range = {r.probe: r.there for r in nodes.select("v").mapInPandas(_truth(probes, threshold), "probe long, there long").groupBy("probe").agg(F.sum("there").alias("there")).collect()}
    made = nodes.sparkSession.createDataFrame([(k, 0, v, True) for k, v in probes], "id long, n long, v binary, probe boolean")
    everything = nodes.select("id", "n", "v", F.lit(False).alias("probe")).unionByName(made)
    most = max(map(len, centers.values()), default=1)
    while True:
        got, core, member = _one_pass(everything, centers, overlap, threshold, chunk, cluster)
        hits = got.where("probe is not null").select("probe", "hit").distinct().count()
        recall = hits / max(1, sum(in_range.values())) if in_range else 1.0
        if recall >= RECALL or overlap >= most:
            break
        overlap = min(most, 2 * overlap)
    if probes and recall < LEAST:
        raise RuntimeError(f"recall {recall:.3f} of near vectors stays below {LEAST}")
    if report is not None:
        audit = got.agg(F.sum("found").alias("f"), F.sum("there").alias("t")).first()
        report.update(recall=recall, overlap=overlap, shard_recall=(audit.f or 0) / audit.t if audit.t else 1.0, copies=member.where("not probe").count() / max(1, total))
    # a core's vectors all link with each other: a count and a star say so
    core = cut_lineage(core.join(nodes.select("id", "n"), "id"))
    whole = core.groupBy("core").agg(F.sum("n").alias("w"), F.min("id").alias("b"))
    core = core.join(whole, "core")
    links = got.where("id is not null").select("id", "links").unionByName(core.select("id", (F.col("w") - F.col("n")).alias("links"))).groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(got.where("a is not null").select("a", "b").unionByName(core.select(F.col("id").alias("a"), "b")))
    named = nodes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = cut_lineage(named)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_v = named.join(smallest, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = unit_rows.join(by_v, "v").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("rows")).join(linked.groupBy("vec_id").agg(F.count("*").alias("valid")), "vec_id", "left")
    rest = rest.where("vec_id is null or rows > coalesce(valid, 0)").select("vec_id", F.explode(F.sequence(F.lit(1), (F.col("rows") - F.coalesce("valid", F.lit(0))).cast("int"))).alias("k"))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
