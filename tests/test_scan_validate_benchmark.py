"""Folder scan with odd names, checks of inputs, statistics, format evaluators, the benchmark row and the oracles of search and checksum repair."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fragweave.operators import graph, png, repair, search
from fragweave.operators.damage import DamageConfig
from fragweave.operators.overlap import tolerant_overlap
from fragweave.plans import benchmark, catalogue, recover
from fragweave.sources import synthetic
from fragweave.sources.fragments import load_directory, load_file
from tests.helpers import brute_edge, fragments


def test_scan_reads_every_regular_file(spark, tmp_path):
    names = ["_a.bin", ".b.bin", "c.bin", "d[1].bin", "e*.bin", "f g.bin", "h%20.bin", "i,j.bin", "_metadata", "ü.bin", "empty", "x._COPYING_"]
    for i, n in enumerate(names):
        (tmp_path / n).write_bytes(b"" if n == "empty" else bytes([i, 0, 255]) * (i + 1))
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "below.bin").write_bytes(b"no")
    got = load_directory(spark, str(tmp_path)).orderBy("node_id").collect()
    want = sorted(names, key=str.encode)
    assert [r.filename for r in got] == want and [r.node_id for r in got] == list(range(len(names)))
    assert all(bytes(r.data) == (tmp_path / r.filename).read_bytes() and r.size == len(r.data) for r in got)
    with pytest.raises(ValueError):
        load_directory(spark, str(tmp_path / "c.bin"))
    assert [(r.filename, bytes(r.data)) for n in ("_a.bin", "c.bin", "empty") for r in load_file(spark, str(tmp_path / n)).collect()] == [(n, (tmp_path / n).read_bytes()) for n in ("_a.bin", "c.bin", "empty")]
    (tmp_path / "none").mkdir()
    assert load_directory(spark, str(tmp_path / "none")).count() == 0


def test_graph_and_payloads_have_to_match(spark):
    nodes = fragments(spark, ["ABCD", "CDEF"])
    known = nodes.withColumn("size", F.length("data").cast("bigint"))
    edges = graph.build(nodes, graph.GraphConfig(2))
    search.validate(known, nodes, edges)
    for bad in (known.where("node_id = 0"), known.withColumn("size", F.col("size") + 1), known.withColumn("filename", F.lit("z")), known.withColumn("node_id", F.col("node_id") + 1)):
        with pytest.raises(ValueError):
            search.validate(bad, nodes)
    for bad in (edges.withColumn("overlap", F.lit(9).cast("bigint")), edges.withColumn("dst", F.lit(7).cast("bigint")), edges.withColumn("dst", F.col("src"))):
        with pytest.raises(ValueError):
            search.validate(known, nodes, bad)
    steps = search.greedy(nodes, edges)
    for bad in (steps.withColumn("overlap_from_previous", F.lit(9).cast("bigint")), steps.withColumn("node_id", F.col("node_id") + 5)):
        with pytest.raises(Exception, match="overlap larger|no payload"):
            search.materialise(bad, nodes).collect()


@pytest.mark.parametrize("rows, least, k, strategy, threads, used", [(["ABCD", "CDEF"], 2, 0, "indexed", 4, 4), (["ABCD", "CDEF"], 2, 1, "indexed", 4, 1), (["AB", "XY"], 2, 0, "indexed", 4, 1), (["AB", "XY"], 2, 0, "exhaustive", 3, 3), (["AB"], 2, 0, "exhaustive", 3, 1)])
def test_threads_used(spark, rows, least, k, strategy, threads, used):
    nodes = fragments(spark, rows)
    c = graph.GraphConfig(least, k, strategy, threads)
    edges = graph.build(nodes, c)
    row = graph.statistics(nodes, edges, c).first()
    assert row.threads_used == used
    pairs = len(rows) * (len(rows) - 1)
    assert row.candidate_pairs == row.full_checks == (row.edges if strategy == "indexed" and not k else pairs)
    r = recover.reconstruct(nodes, recover.ReconstructOptions(least, k, strategy, threads))
    assert r.traces.first().trace.graph_stats.threads_used == used


def test_a_format_can_be_registered(spark):
    def shortest(candidates):
        return candidates.select("dataset_id", "rank", F.array(-F.length("data").cast("bigint")).alias("ranking_keys"), F.lit(None).alias("facts"))

    with pytest.raises(ValueError):
        recover.ReconstructOptions(2, strategy="beam", beam_width=2, format="short")
    search.EVALUATORS["short"] = shortest
    try:
        nodes = fragments(spark, ["XXABC", "ABCZZ", "BCYYYYY"])
        plain = recover.reconstruct(nodes, recover.ReconstructOptions(2, strategy="beam", beam_width=2))
        short = recover.reconstruct(nodes, recover.ReconstructOptions(2, strategy="beam", beam_width=2, format="short"))
        sizes = [len(r.output.first().data) for r in (plain, short)]
        assert sizes[1] <= sizes[0] and search.EVALUATORS["png"] is png.candidate_evidence
    finally:
        del search.EVALUATORS["short"]


def plain_beam(g, width):
    """Whole paths as tuples, level by level."""
    n = len(g.ids)
    key = lambda s: (len(s[0]) < n, -len(s[0]), -s[1], s[2], s[0])
    beam = sorted((((v,), 0, 0) for v in g.starts()), key=key)[:width]
    if n == 1:
        return beam
    finals = []
    while beam:
        nxt, done = [], []
        for path, o, m in beam:
            grown = [(path + (e[2],), o - e[0], m + e[1]) for e in g.out[path[-1]] if e[2] not in path]
            if not grown:
                finals.append((path, o, m))
            done += [s for s in grown if len(s[0]) == n]
            nxt += [s for s in grown if len(s[0]) < n]
        finals += done
        if done:
            break
        beam = sorted(nxt, key=key)[:width]
    return sorted(finals, key=key)


def test_beam_equals_whole_paths():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        edges = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < rng.choice((0.2, 0.6))]
        rows = [(a, b, rng.randrange(1, 4), 1, rng.randrange(2), True) for a, b in edges]
        g = search._Graph(list(range(n)), *([r[i] for r in rows] for i in range(6)))
        for width in (1, 2, 5):
            got, _ = search.beam_search(g, width)
            assert [(s[4], -s[2], s[3]) for s in sorted(got)] == plain_beam(g, width)


def test_benchmark_row(spark, tmp_path):
    data = random.Random(5).randbytes(3000)
    payloads = spark.createDataFrame([(1, data), (2, data[::-1] + b"tail")], "dataset_id long, data binary")
    frag = recover.FragmentOptions(128, 64, opaque_names=True, seed=4, damage=DamageConfig(duplicate=1, noise=2))
    rows = benchmark.run(payloads, frag, recover.ReconstructOptions(32, 0, "indexed", 2, strategy="beam", beam_width=8, repair="consensus"))
    assert rows.columns == ["dataset_id", *benchmark.COLUMNS] and len(benchmark.COLUMNS) == 38
    for r in rows.collect():
        assert (r.duplicates, r.noise, r.dropped, r.corrupted_bytes, r.threads) == (1, 2, 0, 0, 2)
        assert r.exact_recovery and r.size_delta == 0 and r.recall_numerator == r.recall_denominator == r.original_fragments == r.emitted_fragments - 3
        assert r.graph_nodes == r.emitted_fragments and r.total_ms >= r.graph_ms + r.search_ms > 0
    from fragweave.sources.sinks import write_benchmark

    write_benchmark(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    got = benchmark.timing([{"graph_ms": 1, "search_ms": 2, "repair_ms": 3, "total_ms": 6}, {"graph_ms": 3, "search_ms": 2, "repair_ms": 0, "total_ms": 5}])
    assert got["graph_ms"] == {"average": 2.0, "min": 1.0, "max": 3.0} and got["total_ms"]["average"] == 5.5


def test_stretches_of_one_value_are_counted_not_listed(spark):
    """Duplicates of a fragment that spans blocks: a row a block, not a row a byte."""
    data = bytes(i * 7 & 0xFF for i in range(5000))
    nodes = fragments(spark, [data, data, data[:2000] + b"\x00" + data[2001:]])
    steps = spark.createDataFrame([(1, i, i, 0 if not i else 5000, 0, 0, True) for i in range(3)], "dataset_id long, step_no long, node_id long, overlap_from_previous long, matches long, mismatches long, exact boolean")
    pos = repair.positions(repair.placements(steps, nodes), nodes).collect()
    assert sum(r.length for r in pos) == 5000 and len(pos) <= 8
    odd = [r for r in pos if r.distinct_values > 1]
    assert [(r.position, r.kind, r.support, r.before) for r in odd] == [(2000, "corroborated", 2, data[2000])]


def test_overlap_seeds(spark):
    rows = []
    for seed in synthetic.overlap_seeds().values():
        left, right, least, k = synthetic.overlap_case(seed)
        rows += [(left, right, least, k), (right, left, least, k)]
    assert synthetic.overlap_case(b"ab") is None and len(rows) == 18
    for left, right, least, k in rows:
        d = spark.createDataFrame([(left, right)], "l binary, r binary").select(tolerant_overlap("l", "r", least, k).alias("o")).first().o
        want = brute_edge(left, right, least, k)
        assert (d.length, [m.overlap_offset for m in d.mismatch_details]) == ((want[0], list(want[1])) if want else (0, []))


ORACLES = ["beam_candidates", "beam_output", "crc_repairs", "crc_summary", "graph_stats", "consensus_positions", "repair_counters", "repaired_output", "timeline"]


@pytest.mark.parametrize("name", ORACLES)
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet') WHERE length(text) < 6000 AND doc_id < 120")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000 and doc_id < 120").createOrReplaceTempView("few")
    home = _folder(spark)
    d = catalogue.QUERIES[name](spark, home)
    cur = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(str, (tuple(r[columns.index(c)] for c in sorted(columns)) for r in cur.fetchall())))
    assert sorted(d.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in d.select(*sorted(d.columns)).collect()) == want and want


_HOME: list[str] = []


def _folder(spark):
    if not _HOME:
        import tempfile

        _HOME.append(tempfile.mkdtemp())
        spark.table("few").coalesce(2).write.parquet(f"{_HOME[0]}/documents.parquet")
    return _HOME[0]
