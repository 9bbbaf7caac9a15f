"""Query catalogue: name -> Spark plan over the driver's tables; the DuckDB oracles are in oracles.py.

Binary columns leave as upper-case hex, payloads of unbounded size as size and MD5, and absent ids and indices as -1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.operators import damage as dmg
from fragweave.operators import evaluate, graph, overlap, png, repair, search, shard, trace
from fragweave.plans import oracles
from fragweave.plans import scenarios as sc
from fragweave.session import cut_lineage
from fragweave.sources.fragments import inspect, with_node_ids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _hexed(d: DataFrame) -> DataFrame:
    return d.withColumn("data", F.hex("data"))


def _digest(d: DataFrame) -> DataFrame:
    return d.select("dataset_id", F.length("data").cast("bigint").alias("size"), F.md5("data").alias("md5"))


@query
def shard_documents(spark, sf_dir):
    """Every document's bytes as overlapping fragments."""
    return _hexed(shard.shard(sc.payloads(spark, sf_dir), sc.SIZE, sc.OVERLAP))


@query
def shard_stats(spark, sf_dir):
    """Number, total, least, mean and largest size of each document's fragments."""
    d = shard.shard(sc.payloads(spark, sf_dir), sc.SIZE, sc.OVERLAP).withColumn("n", F.length("data").cast("bigint"))
    return d.groupBy("dataset_id").agg(F.count("*").alias("fragments"), F.sum("n").alias("total_bytes"), F.min("n").alias("least"), F.max("n").alias("largest"), F.avg("n").alias("mean_bytes"))


@query
def inspect_preview(spark, sf_dir):
    """Size and first bytes of each document."""
    return inspect(sc.payloads(spark, sf_dir), "dataset_id")


@query
def load_order(spark, sf_dir):
    """File names and node ids of clean shards."""
    d = shard.filenames(shard.shard(sc.payloads(spark, sf_dir), sc.SIZE, sc.OVERLAP))
    return with_node_ids(d).select("dataset_id", "filename", "node_id", "frag_id", F.length("data").cast("bigint").alias("size"))


_EDGE = ["dataset_id", "src", "dst", "overlap", "matches", "mismatches", "exact"]


@query
def edges_indexed(spark, sf_dir):
    """Exact overlaps between the clean fragments of each document."""
    return overlap.indexed_edges(sc.clean_nodes(spark, sf_dir), sc.LEAST).select(_EDGE)


@query
def edges_tolerant(spark, sf_dir):
    """Overlaps with at most one mismatch between damaged fragments."""
    return overlap.indexed_edges(sc.Recovery(spark, sf_dir).nodes, sc.LEAST, sc.MISSES).select(_EDGE)


@query
def edge_mismatches(spark, sf_dir):
    """Where approximate overlaps differ."""
    d = overlap.indexed_edges(sc.Recovery(spark, sf_dir).nodes, sc.LEAST, sc.MISSES)
    return d.select("dataset_id", "src", "dst", F.inline("mismatch_details"))


@query
def graph_stats(spark, sf_dir):
    """Pairs, edges and strategy of each damaged document's graph."""
    return sc.Recovery(spark, sf_dir).stats


@query
def top_edges(spark, sf_dir):
    """The 20 strongest overlaps of each document's clean fragments: the smallest useful analysis."""
    nodes = sc.clean_nodes(spark, sf_dir)
    edges = graph.by_rank(overlap.indexed_edges(nodes, sc.LEAST))
    d = graph.top_edges(edges, 20)
    similarity = F.when(F.col("overlap") == 0, 0.0).otherwise(F.round(100.0 * F.col("matches") / F.col("overlap"), 2))
    return d.select(*_EDGE, "rank", similarity.alias("similarity"))


@query
def node_degrees(spark, sf_dir):
    """Degrees, overlap sums and strongest outgoing overlap of each node."""
    return sc.Recovery(spark, sf_dir).degrees.drop("filename")


@query
def adjacency(spark, sf_dir):
    """Sorted outgoing neighbours of each node."""
    d = graph.adjacency(sc.Recovery(spark, sf_dir).edges)
    return d.select("dataset_id", "node_id", F.array_join(F.transform("neighbours", lambda n: n["node_id"].cast("string")), ",").alias("neighbours"))


@query
def start_nodes(spark, sf_dir):
    """Where greedy search begins."""
    return graph.start_nodes(sc.Recovery(spark, sf_dir).degrees)


@query
def beam_starts(spark, sf_dir):
    """Where beam search begins."""
    return sc.by_size(spark, sf_dir, lambda r: r.starts)


@query
def greedy_path(spark, sf_dir):
    """Steps of each document's greedy path."""
    return sc.by_size(spark, sf_dir, lambda r: r.steps)


@query
def greedy_output(spark, sf_dir):
    """Size and digest of the merged bytes."""
    return _digest(sc.Recovery(spark, sf_dir).merged)


@query
def path_totals(spark, sf_dir):
    """Totals of each greedy path."""
    return sc.by_size(spark, sf_dir, lambda r: r.totals)


@query
def beam_candidates(spark, sf_dir):
    """The three best candidates of beam search over each document."""
    r = sc.Recovery(spark, sf_dir)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    d = search.beam(r.nodes, r.edges, sc.WIDTH).where("rank <= 3")
    return d.select(*[c for c in d.columns if c not in ("path", "overlaps")], join("path"), join("overlaps"))


@query
def beam_output(spark, sf_dir):
    """Size and digest of what the best beam candidate merges to."""
    r = sc.Recovery(spark, sf_dir)
    best = cut_lineage(search.beam(r.nodes, r.edges, sc.WIDTH).where("rank = 1"))
    return _digest(search.materialise(search.steps_of(best, r.edges), r.nodes))


@query
def placements(spark, sf_dir):
    """Where each step's fragment lies in the output."""
    return sc.by_size(spark, sf_dir, lambda r: r.places)


@query
def consensus_votes(spark, sf_dir):
    """Votes by position and value where two fragments or more lie."""
    r = sc.Recovery(spark, sf_dir)
    return repair.votes(r.places, r.nodes)


@query
def consensus_positions(spark, sf_dir):
    """Repaired and ambiguous positions."""
    d = sc.by_size(spark, sf_dir, lambda r: r.disputed)
    return d.withColumn("votes", repair.vote_text())


@query
def repair_counters(spark, sf_dir):
    """Counts of redundant, conflicting, corroborated, repaired and ambiguous positions."""
    r = sc.Recovery(spark, sf_dir)
    return repair.counters(r.positions, r.steps.select("dataset_id").distinct())


@query
def repaired_output(spark, sf_dir):
    """Size and digest of the repaired bytes."""
    return _digest(sc.Recovery(spark, sf_dir).repaired)


@query
def repair_report(spark, sf_dir):
    """The rows of the consensus repair report."""
    return png.report(sc.Recovery(spark, sf_dir).positions)


@query
def damage_drop(spark, sf_dir):
    """What is left when each document loses a fragment."""
    kept, gone = dmg.drop(shard.shard(sc.payloads(spark, sf_dir), sc.SIZE, sc.OVERLAP), 1, 5)
    mark = lambda d, s: d.select("dataset_id", "frag_id", F.lit(s).alias("dropped"))
    return mark(kept, False).unionByName(mark(gone, True))


@query
def damage_roles(spark, sf_dir):
    """Role and source of every emitted fragment."""
    return sc.Recovery(spark, sf_dir).damage.roles.withColumn("source_frag_id", F.coalesce("source_frag_id", F.lit(-1)))


@query
def damage_changes(spark, sf_dir):
    """The bytes that damage changes."""
    return sc.Recovery(spark, sf_dir).damage.changes


@query
def damage_fragments(spark, sf_dir):
    """All fragments after damage."""
    return _hexed(sc.Recovery(spark, sf_dir).damage.fragments)


@query
def emission(spark, sf_dir):
    """Order and opaque names of emitted fragments."""
    d = dmg.opaque_names(dmg.shuffled(sc.Recovery(spark, sf_dir).damage.fragments, 3), 3)
    return d.select("dataset_id", "frag_id", "position", "filename")


@query
def png_chunks(spark, sf_dir):
    """Chunks of the synthetic PNG files."""
    return png.chunk_rows(png.analyse(sc.png_files(spark, sf_dir)))


@query
def png_issues(spark, sf_dir):
    """Issues of the synthetic PNG files."""
    return png.issue_rows(png.analyse(sc.png_files(spark, sf_dir)))


@query
def png_summary(spark, sf_dir):
    """Validity, checksum counts and header of each file."""
    return png.analyse(sc.png_files(spark, sf_dir)).select("dataset_id", "signature_valid", "parsing_completed", "structurally_valid", "semantically_valid", "all_crcs_valid", "valid_crc_count", "invalid_crc_count", F.size("chunks").alias("chunks"), "ihdr.*")


@query
def png_evidence(spark, sf_dir):
    """Ranking keys and facts of each file."""
    d = png.evidence(png.analyse(sc.png_files(spark, sf_dir)))
    keys = F.array_join(F.transform("ranking_keys", lambda x: x.cast("string")), ",")
    facts = F.array_join(F.transform("facts", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "; ")
    return d.select("dataset_id", keys.alias("ranking_keys"), facts.alias("facts"))


@query
def crc_repairs(spark, sf_dir):
    """What checksums make of two ambiguous bytes in each file."""
    files, votes = sc.png_damage(sc.png_files(spark, sf_dir))
    d = png.crc_repair(cut_lineage(files), cut_lineage(votes))[1]
    return d.na.fill({"c_at": -1, "before": -1, "after": -1, "stored_crc": -1, "reason": ""})


@query
def crc_summary(spark, sf_dir):
    """Eligible bytes, chunks tried and checksums before and after repair."""
    files, votes = sc.png_damage(sc.png_files(spark, sf_dir))
    files = cut_lineage(files)
    fixed, rows = png.crc_repair(files, cut_lineage(votes))
    return png.crc_summary(files, fixed, rows)


@query
def recovery_metrics(spark, sf_dir):
    """Metrics of each document's recovery against the truth."""
    return sc.Recovery(spark, sf_dir).metrics


@query
def recovery_aggregate(spark, sf_dir):
    """Means over all documents."""
    return evaluate.aggregate(sc.Recovery(spark, sf_dir).metrics)


@query
def trace_summary(spark, sf_dir):
    """Each trace's JSON, written, read back and checked."""
    d = trace.parse(trace.to_json(sc.by_size(spark, sf_dir, lambda r: r.traces)))
    return d.select("dataset_id", "error", F.size("trace.fragments").alias("fragments"), F.size("trace.edges").alias("edges"), F.size("trace.selected_path").alias("path"), F.size("trace.mismatches").alias("mismatches"), F.size("trace.repairs").alias("repairs"), F.col("trace.unresolved_ambiguities").alias("unresolved"), "trace.reconstruction.*", F.col("trace.graph_stats.strategy").alias("graph_strategy"))


@query
def trace_edges_filtered(spark, sf_dir):
    """Approximate edges off the path, with their labels."""
    d = trace.filter_edges(sc.by_size(spark, sf_dir, lambda r: r.traces), exact=False, path=False)
    return d.withColumn("label", trace.edge_label()).drop("mismatch_details")


@query
def path_edges(spark, sf_dir):
    """The edges that the path joins."""
    return trace.path_edges(sc.by_size(spark, sf_dir, lambda r: r.traces)).drop("mismatch_details")


@query
def join_index(spark, sf_dir):
    """Every edge's place on the path."""
    return trace.join_indices(sc.by_size(spark, sf_dir, lambda r: r.traces)).select("dataset_id", "index", "src", "dst", "join_index")


@query
def adjacent_joins(spark, sf_dir):
    """The nearest joins with mismatches before and after each join."""
    return trace.adjacent_joins(sc.by_size(spark, sf_dir, lambda r: r.traces), mismatches_only=True).select("dataset_id", "join_index", "src", "dst", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


@query
def timeline(spark, sf_dir):
    """The viewer's timeline."""
    d = sc.by_size(spark, sf_dir, lambda r: r.timeline)
    return d.withColumn("edge_index", F.coalesce("edge_index", F.lit(-1))).withColumn("repair_index", F.coalesce("repair_index", F.lit(-1)))


@query
def layout(spark, sf_dir):
    """Where the viewer draws each fragment."""
    return trace.layout(sc.by_size(spark, sf_dir, lambda r: r.traces))


@query
def inspector(spark, sf_dir):
    """Degrees and path place of each fragment in the viewer."""
    return trace.inspector(sc.by_size(spark, sf_dir, lambda r: r.traces))


@query
def trace_mismatches(spark, sf_dir):
    """The path's mismatches as the viewer shows them."""
    return trace.mismatch_rows(sc.by_size(spark, sf_dir, lambda r: r.traces))


ORACLES: dict[str, str] = oracles.all_oracles()
