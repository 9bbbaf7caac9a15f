"""Overlap graph: order of edges, adjacency, statistics, start nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragweave.operators.overlap import exhaustive_edges, indexed_edges


@dataclass(frozen=True)
class GraphConfig:
    """How to build a graph. An indexed request with mismatches is reported as falling back, though the plan needs no fallback."""

    min_overlap: int = 1
    max_mismatches: int = 0
    strategy: str = "exhaustive"
    threads: int = 1

    def __post_init__(self):
        if self.threads < 1:
            raise ValueError("threads have to be positive")
        if self.min_overlap < 1:
            raise ValueError("the least overlap has to be positive")
        if self.max_mismatches < 0:
            raise ValueError("mismatches can't be negative")
        if self.strategy not in ("exhaustive", "indexed"):
            raise ValueError("strategy has to be exhaustive or indexed")

    @property
    def approximate_fallback(self) -> bool:
        return self.strategy == "indexed" and self.max_mismatches > 0

    @property
    def effective_strategy(self) -> str:
        return "exhaustive" if self.approximate_fallback else self.strategy


def build(nodes: DataFrame, config: GraphConfig) -> DataFrame:
    """(dataset_id, node_id, data) -> edges. The seed join gives the same edges for either strategy, so it always runs."""
    return indexed_edges(nodes, config.min_overlap, config.max_mismatches)


def build_exhaustive(nodes: DataFrame, config: GraphConfig) -> DataFrame:
    """The same edges from all pairs; for small datasets and for tests."""
    return exhaustive_edges(nodes, config.min_overlap, config.max_mismatches)


def with_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with src_path and dst_path; nodes: (dataset_id, node_id, filename)."""
    n = nodes.select("dataset_id", F.col("node_id").alias("k"), F.col("filename").alias("p"))
    out = edges.join(n.withColumnsRenamed({"k": "src", "p": "src_path"}), ["dataset_id", "src"])
    return out.join(n.withColumnsRenamed({"k": "dst", "p": "dst_path"}), ["dataset_id", "dst"])


def by_rank(edges: DataFrame) -> DataFrame:
    """with_paths() where node ids are the ranks of the file names, as a scan gives them: ids order edges as names would, without a join."""
    return edges.withColumns({"src_path": F.col("src"), "dst_path": F.col("dst")})


def edge_order():
    """Larger overlap, fewer mismatches, source path, destination path, ids; for edges with paths."""
    return [F.desc("overlap"), F.asc("mismatches"), F.asc("src_path"), F.asc("dst_path"), F.asc("src"), F.asc("dst")]


def ranked(edges: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Edges with rank, their place in edge order within a dataset."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*edge_order())))


def top_edges(edges: DataFrame, n: int = 20) -> DataFrame:
    """The first n edges of each dataset in edge order, with rank."""
    return ranked(edges).where(F.col("rank") <= n)


def adjacency(edges: DataFrame, outgoing: bool = True) -> DataFrame:
    """(dataset_id, node_id, neighbours): neighbours in edge order, as structs."""
    own, other = ("src", "dst") if outgoing else ("dst", "src")
    item = F.struct((-F.col("overlap")).alias("neg_overlap"), "mismatches", F.col(f"{other}_path").alias("path"), F.col(other).alias("node_id"), "overlap", "matches", "exact")
    return edges.groupBy("dataset_id", F.col(own).alias("node_id")).agg(F.sort_array(F.collect_list(item)).alias("neighbours"))


def statistics(nodes: DataFrame, edges: DataFrame, config: GraphConfig) -> DataFrame:
    """A row per dataset: nodes, theoretical pairs, candidates, full checks, exact and approximate edges, strategy.

    Candidates and full checks are what the strategy asks for: exhaustively all pairs; by index, the
    pairs whose prefix and suffix agree at some length, which are those with an exact edge. The plan
    may verify fewer. Threads serve only where exact pairs are evaluated.
    """
    n = nodes.groupBy("dataset_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("dataset_id").agg(F.count("*").alias("edges"), F.count_if("exact").alias("exact_edges"))
    return counted(n.join(e, "dataset_id", "left").na.fill(0, ["edges", "exact_edges"]), config)


def counted(d: DataFrame, config: GraphConfig, *others: str) -> DataFrame:
    """statistics() from the numbers of each dataset: (dataset_id, nodes, edges, exact_edges); other columns stay behind them."""
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    checks = F.col("edges") if config.effective_strategy == "indexed" else pairs
    return d.select(
        "dataset_id",
        "nodes",
        pairs.alias("theoretical_pairs"),
        checks.alias("candidate_pairs"),
        checks.alias("full_checks"),
        "edges",
        "exact_edges",
        (F.col("edges") - F.col("exact_edges")).alias("approximate_edges"),
        F.lit(config.strategy).alias("requested_strategy"),
        F.lit(config.effective_strategy).alias("effective_strategy"),
        F.lit(config.approximate_fallback).alias("approximate_fallback"),
        F.when((checks > 0) & (config.max_mismatches == 0), config.threads).otherwise(1).cast("bigint").alias("threads_used"),
        *others,
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's incoming count and overlap sum, outgoing count and strongest outgoing overlap (0 without edges)."""
    inward = edges.groupBy("dataset_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("in_count"), F.sum("overlap").alias("in_overlap_sum"))
    outward = edges.groupBy("dataset_id", F.col("src").alias("node_id")).agg(F.count("*").alias("out_count"), F.max("overlap").alias("max_out_overlap"))
    d = nodes.select("dataset_id", "node_id", "filename").join(inward, ["dataset_id", "node_id"], "left").join(outward, ["dataset_id", "node_id"], "left")
    return d.na.fill(0, ["in_count", "in_overlap_sum", "out_count", "max_out_overlap"])


def start_nodes(deg: DataFrame) -> DataFrame:
    """The greedy start of each dataset: without incoming edges if there is one, else the least entered; then the strongest out, path, id.

    One minimum covers both cases: nodes without incoming edges have count and sum 0.
    """
    key = F.struct("in_count", "in_overlap_sum", (-F.col("max_out_overlap")).alias("o"), "filename", "node_id")
    return deg.groupBy("dataset_id").agg(F.min(key).alias("k")).select("dataset_id", F.col("k.node_id").alias("node_id"))


def beam_starts(deg: DataFrame) -> DataFrame:
    """All nodes without incoming edges; in a dataset without any, the greedy start."""
    free = deg.where("in_count = 0").select("dataset_id", "node_id")
    cyclic = start_nodes(deg).join(free.select("dataset_id").distinct(), "dataset_id", "left_anti")
    return free.unionByName(cyclic)
