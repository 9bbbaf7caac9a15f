"""Path search over overlap graphs: greedy and beam, a dataset at a time, many datasets in parallel.

The search sees edges and names, never payloads; datasets are independent, so each becomes one row
of arrays, and Arrow batches of rows go to a Python function. Payloads join the chosen path afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = "step_no long, node_id long, overlap_from_previous long, matches long, mismatches long, exact boolean"
_CANDIDATE = "rank long, complete boolean, n_steps long, overlap long, mismatches long, approximate_joins long, path array<long>, overlaps array<long>"
_STATS = "states_expanded long, states_generated long, maximum_beam_size long, complete_candidates long"


class _Graph:
    """One dataset: nodes by (path, id), sorted out-edges as (-overlap, mismatches, node, matches, exact), degrees.

    ids: node ids in order of path and id. The other lists are the edges' columns.
    """

    def __init__(self, ids, src, dst, overlap, matches, mismatches, exact):
        self.ids = [int(v) for v in ids]
        self.place = {v: i for i, v in enumerate(self.ids)}
        n = len(self.ids)
        self.out: list[list[tuple]] = [[] for _ in range(n)]
        self.into, self.sums = [0] * n, [0] * n
        for s, d, o, m, x, e in zip(src, dst, overlap, matches, mismatches, exact):
            a, b = self.place[int(s)], self.place[int(d)]
            self.out[a].append((-int(o), int(x), b, int(m), bool(e)))
            self.into[b] += 1
            self.sums[b] += int(o)
        for e in self.out:
            e.sort()

    def start(self) -> int:
        return min(range(len(self.ids)), key=lambda v: (self.into[v], self.sums[v], self.out[v][0][0] if self.out[v] else 0, v))

    def starts(self) -> list[int]:
        return [v for v in range(len(self.ids)) if not self.into[v]] or [self.start()]


_COLUMNS = ["src", "dst", "overlap", "matches", "mismatches", "exact"]


def _graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per dataset: its node ids in order and its edges' columns as arrays. Datasets without edges are there too."""
    by_path = F.sort_array(F.collect_list(F.struct("filename", "node_id")))
    n = nodes.groupBy("dataset_id").agg(F.transform(by_path, lambda x: x["node_id"]).alias("ids"))
    e = edges.groupBy("dataset_id").agg(F.collect_list(F.struct(*_COLUMNS)).alias("e"))
    d = n.join(e, "dataset_id", "left")
    kinds = dict(edges.dtypes)
    column = lambda c: F.coalesce(F.transform("e", lambda x: x[c]), F.array().cast(f"array<{kinds[c]}>")).alias(c)
    return d.select("dataset_id", "ids", *[column(c) for c in _COLUMNS])


def _each(pdf: pd.DataFrame):
    """(dataset_id, graph) of each row of _graphs()."""
    for row in zip(pdf["dataset_id"], pdf["ids"], *(pdf[c] for c in _COLUMNS)):
        yield row[0], _Graph(*row[1:])


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for ds, g in _each(pdf):
            v = g.start()
            used, k = {v}, 0
            rows.append((ds, 0, g.ids[v], 0, 0, 0, True))
            while True:
                e = next((e for e in g.out[v] if e[2] not in used), None)
                if e is None:
                    break
                v, k = e[2], k + 1
                used.add(v)
                rows.append((ds, k, g.ids[v], -e[0], e[3], e[1], e[4]))
        yield pd.DataFrame(rows, columns=["dataset_id", "step_no", "node_id", "overlap_from_previous", "matches", "mismatches", "exact"])


def greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset_id, step_no, node_id, overlap_from_previous, matches, mismatches, exact): from the start node always the first edge to an unused node."""
    return _graphs(nodes, edges).mapInPandas(_greedy, f"dataset_id {dict(nodes.dtypes)['dataset_id']}, {STEP}")


class _State:
    """A path as its last node and what came before: no state copies another's path."""

    __slots__ = ("before", "node", "steps", "overlap", "miss", "join", "order")

    def __init__(self, before, node: int, overlap: int, miss: int, join: tuple | None):
        self.before, self.node, self.join = before, node, join
        self.steps = before.steps + 1 if before else 1
        self.overlap, self.miss = overlap, miss
        self.order = 0  # the place of its path among those of its level's beam

    def unwind(self) -> tuple[list[int], list[tuple]]:
        """(path, joins)."""
        path, joins, s = [], [], self
        while s:
            path.append(s.node)
            if s.join:
                joins.append(s.join)
            s = s.before
        return path[::-1], joins[::-1]


def beam_search(g: _Graph, width: int) -> tuple[list[tuple], tuple[int, int, int]]:
    """(terminal states, (expanded, generated, largest beam)) of one dataset.

    A state is (not complete, -steps, -overlap, mismatches, path, joins) and sorts so. A
    level that completes a path ends the search; incomplete states made in that level, and
    states that the width cuts, are lost. Paths of a level have one length, so two of them compare
    as the places of their parents' paths and then their last nodes; a node on the path is found
    by the marks of its state's ancestors.
    """
    n = len(g.ids)

    def cut(states: list[_State]) -> list[_State]:
        # ranked by overlap, mismatches and path
        keyed = heapq.nsmallest(width, states, key=lambda s: (-s.overlap, s.miss, s.before.order if s.before else 0, s.node))
        for k, s in enumerate(sorted(keyed, key=lambda s: (s.before.order if s.before else 0, s.node))):
            s.order = k
        return keyed

    made = [_State(None, v, 0, 0, None) for v in g.starts()]
    beam = cut(made)
    generated, expanded, largest, finals = len(made), 0, len(beam), []
    if n == 1:
        finals, beam = beam, []
    # the nodes of each state of the beam; a child's are its parent's and one more, copied only for those that stay
    used = {id(s): {s.node} for s in beam}
    while beam:
        nxt, complete = [], False
        for s in beam:
            expanded += 1
            on, grown = used[id(s)], False
            for e in g.out[s.node]:
                if e[2] in on:
                    continue
                grown = True
                generated += 1
                child = _State(s, e[2], s.overlap - e[0], s.miss + e[1], (-e[0], e[3], e[1], e[4]))
                if child.steps < n:
                    nxt.append(child)
                else:
                    finals.append(child)
                    complete = True
            if not grown:
                finals.append(s)
        if complete:
            break
        beam = cut(nxt)
        children: dict[int, int] = {}
        for s in beam:
            children[id(s.before)] = children.get(id(s.before), 0) + 1
        kept: dict[int, set[int]] = {}
        for s in beam:
            k = id(s.before)
            children[k] -= 1
            on = set(used[k]) if children[k] else used.pop(k)  # the last child takes its parent's set over
            on.add(s.node)
            kept[id(s)] = on
        used = kept
        largest = max(largest, len(beam))
    out = []
    for s in finals:
        path, joins = s.unwind()
        out.append((s.steps < n, -s.steps, -s.overlap, s.miss, tuple(path), tuple(joins)))
    return out, (expanded, generated, largest)


def _beam(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ds, g in _each(pdf):
                finals, (expanded, generated, largest) = beam_search(g, width)
                finals.sort()
                done = sum(not s[0] for s in finals)
                for k, s in enumerate(finals):
                    joins = s[5]
                    rows.append(
                        {
                            "dataset_id": ds, "rank": k + 1, "complete": not s[0], "n_steps": -s[1], "overlap": -s[2], "mismatches": s[3],
                            "approximate_joins": sum(not j[3] for j in joins), "path": [g.ids[v] for v in s[4]], "overlaps": [0] + [j[0] for j in joins],
                            "states_expanded": expanded, "states_generated": generated, "maximum_beam_size": largest, "complete_candidates": done,
                        }
                    )
            if rows:
                yield pd.DataFrame(rows)

    return run


def beam(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """Ranked candidates of each dataset with the statistics of its search: see beam_search()."""
    if width < 1:
        raise ValueError("the width has to be positive")
    return _graphs(nodes, edges).mapInPandas(_beam(width), f"dataset_id {dict(nodes.dtypes)['dataset_id']}, {_CANDIDATE}, {_STATS}")


#: Format name -> function of (dataset_id, rank, data) -> (dataset_id, rank, ranking_keys array<long>, facts): the extension
#: point. A format registered here can be asked for by name in reconstruction; operators.png registers itself.
EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def rerank(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates ranked anew: complete, then format evidence, steps, overlap, fewer mismatches, the earlier rank (which ends in the path)."""
    d = candidates.join(evidence.select("dataset_id", "rank", "ranking_keys"), ["dataset_id", "rank"], "left")
    # least first: structs and arrays compare element by element, so negated keys sort descending
    keys = F.transform(F.coalesce("ranking_keys", F.array().cast("array<bigint>")), lambda x: -x)
    key = F.struct((~F.col("complete")).alias("a"), keys.alias("b"), (-F.col("n_steps")).alias("c"), (-F.col("overlap")).alias("d"), F.col("mismatches").alias("e"), F.col("rank").alias("f"))
    from pyspark.sql import Window

    return d.withColumn("new_rank", F.row_number().over(Window.partitionBy("dataset_id").orderBy(key)).cast("bigint"))


def validate(graph_nodes: DataFrame, payloads: DataFrame, edges: DataFrame | None = None) -> None:
    """Raises ValueError unless a graph's nodes are those of the payloads: ids 0 .. n - 1 of each dataset, names and sizes.

    graph_nodes: (dataset_id, node_id, filename, size); payloads: (dataset_id, node_id, filename,
    data). With edges also that their ends are nodes and that no overlap is larger than either end.
    """
    key = ["dataset_id", "node_id"]
    p = payloads.select(*key, F.col("filename").alias("_name"), F.length("data").cast("bigint").alias("_size"), F.lit(True).alias("_there"))
    d = graph_nodes.select(*key, "filename", "size", F.lit(True).alias("_known")).join(p, key, "full")
    if not d.where("_known is null or _there is null").isEmpty():
        raise ValueError("graph and payloads don't hold the same fragments")
    if not d.where("not (filename <=> _name) or not (size <=> _size)").isEmpty():
        raise ValueError("the graph doesn't match the payloads")
    ids = graph_nodes.groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("k"), F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    if not ids.where("n <> k or a <> 0 or b <> n - 1").isEmpty():
        raise ValueError("node ids aren't 0 .. n - 1")
    if edges is not None:
        size = graph_nodes.select("dataset_id", "node_id", "size")
        e = edges.select("dataset_id", "src", "dst", "overlap")
        for end in ("src", "dst"):
            e = e.join(size.withColumnsRenamed({"node_id": end, "size": f"{end}_size"}), ["dataset_id", end], "left")
        if not e.where("src_size is null or dst_size is null or src = dst or overlap < 1 or overlap > src_size or overlap > dst_size").isEmpty():
            raise ValueError("an edge doesn't match the fragments")


def steps_of(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """The steps of one candidate of each dataset, like greedy()'s."""
    d = candidates.select("dataset_id", F.posexplode(F.arrays_zip("path", "overlaps")).alias("step_no", "x"), "path")
    d = d.select("dataset_id", F.col("step_no").cast("long"), F.col("x.path").alias("node_id"), F.col("x.overlaps").alias("overlap_from_previous"), F.get("path", F.col("step_no") - 1).alias("src"))
    e = edges.select("dataset_id", "src", F.col("dst").alias("node_id"), "matches", "mismatches", "exact")
    d = d.join(e, ["dataset_id", "src", "node_id"], "left")
    return d.select("dataset_id", "step_no", "node_id", "overlap_from_previous", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"), F.coalesce("exact", F.lit(True)).alias("exact"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Datasets (dataset_id, path, overlaps, ids, parts, at, after) to (dataset_id, data)."""
    for batch in batches:
        path, overlaps, ids = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("path", "overlaps", "ids"))
        steps, nodes = (batch[c].offsets.to_numpy() - batch[c].offsets[0].as_py() for c in ("path", "ids"))
        parts = batch["parts"].flatten()
        places, values = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("at", "after"))
        changes = batch["at"].offsets.to_numpy() - batch["at"].offsets[0].as_py()
        done, size, first = [], 0, 0
        for i in range(len(batch)):
            u, v = nodes[i], nodes[i + 1]
            order = np.argsort(ids[u:v], kind="stable")
            own, want = ids[u:v][order], path[steps[i] : steps[i + 1]]
            at = np.searchsorted(own, want)  # places in order of id
            lost = (at >= len(own)) | (own[np.minimum(at, len(own) - 1)] != want) if len(own) else np.ones(len(want), bool)
            if lost.any():
                raise ValueError(f"no payload for a step's fragment: {want[lost][0]}")
            out = []
            for k, p, n in zip(want.tolist(), (u + order[at]).tolist(), overlaps[steps[i] : steps[i + 1]].tolist()):
                part = parts[p].as_buffer()
                if n > len(part):
                    raise ValueError(f"an overlap larger than the fragment: {k}")
                out.append(memoryview(part)[n:])
            whole = b"".join(out)
            z = slice(changes[i], changes[i + 1])
            if z.start < z.stop:
                new, inside = np.frombuffer(whole, np.uint8).copy(), (places[z] >= 0) & (places[z] < len(whole))
                new[places[z][inside]] = values[z][inside]
                whole = new.tobytes()
            done.append(whole)
            size += len(done[-1])
            if size > 4_000_000 or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([batch["dataset_id"].slice(first, i + 1 - first), pa.array(done, pa.binary())], ["dataset_id", "data"])
                done, size, first = [], 0, i + 1


def materialise(steps: DataFrame, nodes: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(dataset_id, data): fragments in order, each without the bytes that overlap what is there. The left bytes win.

    changes: (dataset_id, position, after) of bytes to replace, at most one of a position; those outside are left out.

    A dataset's output is one row, as a file is, so its fragments are gathered once and joined in the
    task. A step without a fragment, or with an overlap larger than it, is an error.
    """
    ordered = F.sort_array(F.collect_list(F.struct("step_no", F.col("node_id").cast("bigint").alias("n"), F.col("overlap_from_previous").cast("bigint").alias("o"))))
    path = steps.where("dataset_id is not null").groupBy("dataset_id").agg(ordered.alias("p"))
    nothing = F.array().cast("array<bigint>")
    if changes is None:
        path = path.withColumns({"at": nothing, "after": nothing})
    else:
        by = changes.groupBy("dataset_id").agg(F.collect_list(F.struct(F.col("position").cast("bigint").alias("a"), F.col("after").cast("bigint").alias("b"))).alias("c"))
        listed = lambda c: F.coalesce(F.transform("c", lambda x: x[c]), nothing)
        path = path.join(by, "dataset_id", "left").withColumns({"at": listed("a"), "after": listed("b")})
    held = nodes.where("data is not null").groupBy("dataset_id").agg(F.collect_list(F.col("node_id").cast("bigint")).alias("ids"), F.collect_list("data").alias("parts"))
    d = path.join(held, "dataset_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    column = lambda c, name: F.transform("p", lambda x: x[c]).alias(name)
    d = d.select("dataset_id", column("n", "path"), column("o", "overlaps"), empty("ids", "bigint"), empty("parts", "binary"), "at", "after")
    return d.mapInArrow(_merge, f"dataset_id {dict(steps.dtypes)['dataset_id']}, data binary")


def totals(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per dataset: steps, overlap, mismatches, approximate joins, recovered size, complete."""
    n = nodes.groupBy("dataset_id").agg(F.count("*").alias("nodes"))
    d = steps.join(nodes.select("dataset_id", "node_id", F.length("data").cast("bigint").alias("size")), ["dataset_id", "node_id"])
    d = d.groupBy("dataset_id").agg(
        F.count("*").alias("n_steps"),
        F.sum("overlap_from_previous").alias("overlap"),
        F.sum("mismatches").alias("mismatches"),
        F.count_if(~F.col("exact")).alias("approximate_joins"),
        F.sum(F.col("size") - F.col("overlap_from_previous")).alias("recovered_size"),
    )
    return d.join(n, "dataset_id").withColumn("complete", F.col("n_steps") == F.col("nodes")).drop("nodes")


def totals_of_lists(lists: DataFrame) -> DataFrame:
    """totals() of within.recover()'s fragments and steps."""
    total = lambda f: F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, s: n + f(s))
    return lists.select(
        "dataset_id",
        F.size("steps").cast("bigint").alias("n_steps"),
        total(lambda s: s["overlap_from_previous"]).alias("overlap"),
        total(lambda s: s["mismatches"]).alias("mismatches"),
        total(lambda s: (~s["exact"]).cast("bigint")).alias("approximate_joins"),
        total(lambda s: s["size"] - s["overlap_from_previous"]).alias("recovered_size"),
        (F.size("steps") == F.size("fragments")).alias("complete"),
    )
