"""Recovery benchmark: damage, rebuild and compare many datasets at once, with times of each phase.

A row has the 38 columns of the benchmark's CSV. Times are of a phase over all datasets of a run,
since one plan works on all of them; they repeat in every row of the run.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.operators import evaluate, graph, repair, search, shard
from fragweave.operators import damage as dmg
from fragweave.plans.recover import FragmentOptions, ReconstructOptions
from fragweave.session import cut_lineage, ship
from fragweave.sources.fragments import with_node_ids

# The columns of the CSV, in order.
COLUMNS = (
    "seed input_bytes fragment_size overlap original_fragments emitted_fragments duplicates noise dropped corrupted_bytes strategy beam_width graph_build threads "
    "io max_mismatches repair graph_nodes graph_edges candidate_pairs overlap_checks selected_fragments selected_originals selected_duplicates selected_noise "
    "recall_numerator recall_denominator order_correct order_comparable consistent_joins selected_genuine_joins exact_recovery output_bytes size_delta graph_ms search_ms "
    "repair_ms total_ms"
).split()


def _timed(work: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """The checkpointed table that some work makes, and its milliseconds."""
    begun = time.perf_counter()
    out = cut_lineage(work())
    return out, (time.perf_counter() - begun) * 1e3


def run(payloads: DataFrame, fragment: FragmentOptions, options: ReconstructOptions, io: str = "buffered") -> DataFrame:
    """(dataset_id, data) -> a row per dataset: dataset_id and COLUMNS. A dataset of which nothing is left has zeros.

    format evidence and checksum repair are no part of the benchmark.
    """
    if options.format != "none" or options.repair not in ("none", "consensus"):
        raise ValueError("the benchmark knows no format, and no repair but consensus")
    ship(payloads.sparkSession)
    seed, d = fragment.seed or 0, fragment.damage
    originals = cut_lineage(shard.shard(payloads, fragment.size, fragment.overlap))
    damaged = dmg.damage(originals, dmg.DamageConfig(d.drop, d.duplicate, d.noise, d.corrupt, seed))
    roles = cut_lineage(damaged.roles)
    nodes = cut_lineage(with_node_ids(cut_lineage(dmg.opaque_names(damaged.fragments, seed).drop("offset"))))
    edges, graph_ms = _timed(lambda: graph.by_rank(graph.build(nodes, options.graph)))
    width = options.beam_width or 8

    def path() -> DataFrame:
        if options.strategy == "greedy":
            return search.greedy(nodes, edges)
        return search.steps_of(search.beam(nodes, edges, width).where("rank = 1"), edges)

    steps, search_ms = _timed(path)
    output, merge_ms = _timed(lambda: search.materialise(steps, nodes))
    repair_ms, events = 0.0, None
    if options.repair == "consensus":
        positions, vote_ms = _timed(lambda: repair.positions(repair.placements(steps, nodes), nodes))
        output, fix_ms = _timed(lambda: repair.apply(output, repair.repairs(positions)))
        repair_ms = vote_ms + fix_ms
        events = repair.repairs(positions).groupBy("dataset_id").agg(F.count("*").alias("repair_events"))
    m = evaluate.metrics(payloads, output, steps, nodes.select("dataset_id", "node_id", "frag_id"), roles, originals, events)
    s = graph.statistics(nodes, edges, options.graph)
    n = lambda t, name: t.groupBy("dataset_id").agg(F.count("*").alias(name))
    kinds = roles.groupBy("dataset_id").agg(*[F.count_if(F.col("role") == r).alias(f"_{r}") for r in ("duplicate", "noise", "dropped")])
    out = m
    for t in (n(originals, "original_fragments"), n(nodes, "emitted_fragments"), n(steps, "selected_fragments"), n(damaged.changes, "corrupted_bytes"), kinds, s.select("dataset_id", "nodes", F.col("edges").alias("graph_edges"), "candidate_pairs", "full_checks", "threads_used")):
        out = out.join(t, "dataset_id", "left")
    out = out.na.fill(0)
    constant = {
        "seed": seed, "fragment_size": fragment.size, "overlap": fragment.overlap, "strategy": options.strategy, "beam_width": width if options.strategy == "beam" else 1, "graph_build": options.graph_build,
        "io": io, "max_mismatches": options.max_mismatches, "repair": options.repair, "graph_ms": graph_ms, "search_ms": search_ms + merge_ms, "repair_ms": repair_ms, "total_ms": graph_ms + search_ms + merge_ms + repair_ms,
    }
    named = {
        "input_bytes": "original_bytes", "duplicates": "_duplicate", "noise": "_noise", "dropped": "_dropped", "threads": "threads_used", "graph_nodes": "nodes", "overlap_checks": "full_checks", "recall_numerator": "represented",
        "recall_denominator": "surviving", "order_correct": "ordered", "order_comparable": "comparable", "consistent_joins": "consistent", "selected_genuine_joins": "genuine", "output_bytes": "reconstructed_bytes",
    }
    return out.select("dataset_id", *[F.lit(constant[c]).alias(c) if c in constant else F.col(named.get(c, c)).alias(c) for c in COLUMNS])


def timing(rows: list[dict]) -> dict[str, dict[str, float]]:
    """average, min and max of the times of several runs, by phase."""
    out = {}
    for c in ("graph_ms", "search_ms", "repair_ms", "total_ms"):
        took = [float(r[c]) for r in rows]
        out[c] = {"average": sum(took) / len(took), "min": min(took), "max": max(took)} if took else {}
    return out


def repeat(payloads: DataFrame, fragment: FragmentOptions, options: ReconstructOptions, iterations: int = 5) -> dict[str, dict[str, float]]:
    """timing() of so many runs of the same."""
    if iterations < 1:
        raise ValueError("iterations have to be positive")
    return timing([run(payloads, fragment, options).first().asDict() for _ in range(iterations)])
