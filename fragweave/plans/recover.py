"""The four verbs as plans: inspect, fragment, analyse, reconstruct. Options are checked before Spark starts work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.operators import damage as dmg
from fragweave.operators import graph, png, repair, search, shard, trace
from fragweave.session import cut_lineage, ship
from fragweave.sources.fragments import load_directory


def positive(text: str, name: str, least: int = 1) -> int:
    """A whole decimal number, all of it digits."""
    if not text.isascii() or not text.isdigit() or int(text) < least:
        raise ValueError(f"{name} has to be a whole number of at least {least}")
    return int(text)


@dataclass(frozen=True)
class FragmentOptions:
    size: int
    overlap: int = 0
    shuffle: bool = False
    opaque_names: bool = False
    seed: int | None = None
    damage: dmg.DamageConfig = dmg.DamageConfig()

    def __post_init__(self):
        d = self.damage
        random = self.shuffle or self.opaque_names or any((d.drop, d.duplicate, d.noise, d.corrupt))
        if self.seed is not None and not random:
            raise ValueError("a seed needs something random: shuffle, opaque names or damage")


@dataclass(frozen=True)
class ReconstructOptions:
    min_overlap: int = 1
    max_mismatches: int = 0
    graph_build: str = "exhaustive"
    threads: int = 1
    io: str = "buffered"
    strategy: str = "greedy"
    beam_width: int | None = None
    candidates: int | None = None
    format: str = "none"
    repair: str = "none"
    report: bool = False

    def __post_init__(self):
        graph.GraphConfig(self.min_overlap, self.max_mismatches, self.graph_build)
        for name, value, allowed in (("strategy", self.strategy, ("greedy", "beam")), ("format", self.format, ("none", *search.EVALUATORS)), ("repair", self.repair, ("none", "consensus", "png")), ("io", self.io, ("buffered", "mmap"))):
            if value not in allowed:
                raise ValueError(f"{name} has to be one of {', '.join(allowed)}")
        if self.threads < 1 or (self.beam_width is not None and self.beam_width < 1) or (self.candidates is not None and self.candidates < 1):
            raise ValueError("threads, width and candidates have to be positive")
        if self.strategy == "greedy" and (self.beam_width is not None or self.candidates is not None):
            raise ValueError("beam width and candidates need the beam strategy")
        if self.strategy == "greedy" and self.format != "none":
            raise ValueError("a format needs the beam strategy")
        if self.repair == "png" and self.format != "png":
            raise ValueError("png repair needs the png format")
        if self.report and self.repair == "none":
            raise ValueError("a repair report needs repair")

    @property
    def graph(self) -> graph.GraphConfig:
        return graph.GraphConfig(self.min_overlap, self.max_mismatches, self.graph_build, self.threads)


def fragment(payloads: DataFrame, options: FragmentOptions) -> dmg.Damage:
    """(dataset_id, data) -> damaged, named, ordered fragments, with truth apart. fragments get filename and position."""
    seed = options.seed or 0
    d = options.damage
    out = dmg.damage(shard.shard(payloads, options.size, options.overlap), dmg.DamageConfig(d.drop, d.duplicate, d.noise, d.corrupt, seed))
    frags = dmg.shuffled(out.fragments, seed) if options.shuffle else out.fragments.withColumn("position", F.col("frag_id"))
    frags = dmg.opaque_names(frags, seed) if options.opaque_names else shard.filenames(frags)
    return dmg.Damage(frags, out.roles, out.changes)


def analyse(nodes: DataFrame, config: graph.GraphConfig, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(strongest edges of each dataset, statistics)."""
    edges = graph.with_paths(graph.build(nodes, config), nodes)
    return graph.top_edges(edges, top), graph.statistics(nodes, edges, config)


@dataclass
class Reconstruction:
    """What reconstruct() finds; output is the final payload of each dataset. partial() tells the exit status 2."""

    output: DataFrame
    steps: DataFrame
    totals: DataFrame
    candidates: DataFrame | None
    positions: DataFrame | None
    crc_rows: DataFrame | None
    report: DataFrame | None
    traces: DataFrame

    def partial(self) -> DataFrame:
        """Datasets whose path doesn't hold all fragments."""
        return self.totals.where("not complete").select("dataset_id")


def reconstruct(nodes: DataFrame, options: ReconstructOptions) -> Reconstruction:
    """Scan to output: graph, search (with format evidence), merge, repair, trace, for all datasets of nodes at once."""
    ship(nodes.sparkSession)
    nodes = cut_lineage(nodes)
    edges = cut_lineage(graph.with_paths(graph.build(nodes, options.graph), nodes))
    candidates = None
    if options.strategy == "greedy":
        steps = cut_lineage(search.greedy(nodes, edges))
    else:
        candidates = cut_lineage(search.beam(nodes, edges, options.beam_width or 8))
        if options.format != "none":
            merged = _merge_all(candidates, edges, nodes)
            candidates = cut_lineage(search.rerank(candidates, search.EVALUATORS[options.format](merged)))
            best = candidates.where("new_rank = 1")
        else:
            best = candidates.where("rank = 1")
        steps = cut_lineage(search.steps_of(best, edges))
    output = search.materialise(steps, nodes)
    totals = search.totals(steps, nodes)
    positions = crc_rows = report = None
    if options.repair != "none":
        fixed, positions = repair.consensus(steps, nodes, output)
        positions, output = cut_lineage(positions), cut_lineage(fixed)
        if options.repair == "png":
            output, crc_rows = png.crc_repair(output, repair.ambiguities(positions))
            crc_rows = cut_lineage(crc_rows)
        report = png.report(positions, crc_rows)
    analysis = png.analyse(output) if options.format == "png" else None
    stats = graph.statistics(nodes, edges, options.graph)
    config = trace.TraceConfig(options.min_overlap, options.max_mismatches, options.graph_build, options.threads, options.strategy, options.beam_width or (8 if options.strategy == "beam" else 1), options.io, options.format, options.repair)
    traces = trace.build(nodes, graph.ranked(edges), steps, totals, stats, config, positions, crc_rows, analysis)
    return Reconstruction(output, steps, totals, candidates, positions, crc_rows, report, traces)


def _merge_all(candidates: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dataset_id, rank, data) of every candidate: merged as datasets of their own."""
    d = candidates.select("dataset_id", "rank", F.posexplode(F.arrays_zip("path", "overlaps")).alias("step_no", "x"))
    d = d.select("dataset_id", "rank", "step_no", F.col("x.path").alias("node_id"), F.col("x.overlaps").alias("o"))
    d = d.join(nodes.select("dataset_id", "node_id", "data"), ["dataset_id", "node_id"])
    part = F.hex(F.substr("data", (F.col("o") + 1).cast("int"), F.length("data")))
    p = d.groupBy("dataset_id", "rank").agg(F.sort_array(F.collect_list(F.struct("step_no", part.alias("h")))).alias("p"))
    return p.select("dataset_id", "rank", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("data"))


def reconstruct_directory(spark: SparkSession, path: str, options: ReconstructOptions) -> Reconstruction:
    """One folder of fragment files; an empty folder is an error."""
    nodes = load_directory(spark, path, io=options.io)
    if nodes.isEmpty():
        raise ValueError(f"no fragments in {path}")
    return reconstruct(nodes, options)
