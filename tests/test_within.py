"""Recovery of a dataset within a task: the same rows as by tables, and next to nothing written."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fragweave.operators import damage as dmg
from fragweave.operators import graph, overlap, repair, search, trace, within
from fragweave.operators.shard import shard
from fragweave.plans import catalogue, scenarios
from fragweave.sources.fragments import with_node_ids
from tests.test_disk import _written

QUERIES = {
    "join_index": 3, "path_edges": 4, "trace_mismatches": 5, "adjacent_joins": 6, "inspector": 7, "layout": 8, "timeline": 10, "trace_edges_filtered": 11,
    "trace_summary": 12, "consensus_positions": 13, "path_totals": 14, "greedy_path": 17, "placements": 18, "beam_starts": 20,
}


def _texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    line = " ".join(rng.choice(words) for _ in range(20))
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 30, 60, 200, 900)] + [(line + "\n") * 12, "A" * 700, "z", "", None, line + line[:90] + line]
    return [(10 * i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("within"))
    spark.createDataFrame(_texts(), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def _rows(d):
    return d.columns, Counter(map(str, d.collect()))


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_whatever_fits(spark, folder, monkeypatch, name):
    got = _rows(catalogue.QUERIES[name](spark, folder))
    assert sum(got[1].values())
    monkeypatch.setattr(overlap, "GATHER", 1000)  # some are too large, and go by shuffles
    assert _rows(catalogue.QUERIES[name](spark, folder)) == got
    monkeypatch.setattr(scenarios, "by_size", lambda s, d, make: make(scenarios.Recovery(s, d)))
    assert _rows(catalogue.QUERIES[name](spark, folder)) == got


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    rng = random.Random(2)
    path = str(tmp_path_factory.mktemp("wide"))
    texts = ["".join(chr(rng.randrange(33, 127)) for _ in range(8000)) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", QUERIES)
def test_next_to_nothing_written(spark, wide, name):
    before = _written(spark)
    catalogue.QUERIES[name](spark, wide).write.format("noop").mode("overwrite").save()
    # of 480,000 bytes of text only the ids move, which tell whether any is there twice
    assert sum(b for k, b in _written(spark).items() if k not in before) < 20_000


def test_lists_equal_tables(spark):
    rng = random.Random(3)
    source = bytes(rng.choice(b"AB") for _ in range(400))
    data = [(str(i), rng.choice([source, rng.randbytes(400)])[rng.randrange(50) : rng.randrange(60, 400)]) for i in range(12)] + [("é", b"A" * 200), ("x", b"abc")]
    payloads = spark.createDataFrame(data, "dataset_id string, data binary")
    config = dmg.DamageConfig(duplicate=3, noise=2, corrupt=3, seed=9)
    for least, k in ((12, 2), (9, 0)):
        d = within.recover(payloads, 48, 20, config, least, k, list(within.LISTS)).cache()
        nodes = with_node_ids(dmg.opaque_names(dmg.damage(shard(payloads, 48, 20), config).fragments, config.seed)).cache()
        edges = graph.ranked(graph.by_rank(overlap.indexed_edges(nodes, least, k))).cache()
        steps = search.greedy(nodes, edges).cache()
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert same(within.rows(d, "fragments", "id", "name", "size"), nodes.select("dataset_id", F.col("node_id").alias("id"), F.col("filename").alias("name"), F.length("data").alias("size")))
        columns = ["src", "dst", "overlap", "matches", "mismatches", "exact", "mismatch_details"]
        listed = d.select("dataset_id", F.posexplode("edges").alias("i", "e")).select("dataset_id", (F.col("i") + 1).alias("rank"), "e.*")
        assert same(listed.select("dataset_id", "rank", *columns), edges.select("dataset_id", "rank", *columns))
        assert same(d.select("dataset_id", F.explode("starts").alias("node_id")), graph.beam_starts(graph.degrees(nodes, edges)))
        assert same(within.rows(d, "steps", *steps.columns[1:]), steps)
        assert same(within.rows(d, "steps", "step_no", "node_id", "start", "size"), repair.placements(steps, nodes))
        odd = repair.positions(repair.placements(steps, nodes), nodes).where("kind <> 'corroborated'").drop("length")
        assert (odd.count() or not k) and same(within.rows(d, "disputed", *odd.columns[1:]), odd)


def test_shared_ids_go_together(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 300), (1, "b" * 300), (2, "c" * 300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(Exception, match="two fragments have one name"):
        catalogue.QUERIES["greedy_path"](spark, str(tmp_path)).collect()
    nulls = tmp_path / "nulls"
    spark.createDataFrame([(None, "a" * 300), (2, "c" * 300)], "doc_id long, text string").write.parquet(str(nulls / "documents.parquet"))
    want = _rows(scenarios.Recovery(spark, str(nulls)).steps)
    assert _rows(catalogue.QUERIES["greedy_path"](spark, str(nulls))) == want


def test_row_functions_in_small_portions(spark, folder, monkeypatch):
    want = {q: _rows(catalogue.QUERIES[q](spark, folder)) for q in ("join_index", "inspector")}
    monkeypatch.setattr(trace, "ITEMS", 50)
    assert {q: _rows(catalogue.QUERIES[q](spark, folder)) for q in want} == want
