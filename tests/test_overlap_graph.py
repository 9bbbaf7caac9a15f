"""Overlaps and graphs: fixtures, and the indexed plan against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from fragweave.operators import graph
from fragweave.operators.overlap import exact_overlap, exhaustive_edges, indexed_edges, tolerant_overlap
from tests.helpers import brute_edge, edge_set, fragments

EXACT = [
    ("ABCDEF", "DEFGHI", 3), ("ABC", "XYZ", 0), ("ABCDEF", "ABCDEF", 6), ("ABCDEF", "EF", 2), ("ABC", "ABCDEF", 3), ("ABC", "CDE", 1),
    ("DEFGHI", "ABCDEF", 0), ("", "ABC", 0), ("ABC", "", 0), ("XXABCYABC", "ABCZ", 3),
]
TOLERANT = [
    ("ABCDEFG", "EFGHIJK", 3, 0, 3, 0), ("XXABCDEF", "ABQDEYZZ", 4, 2, 6, 2), ("PPABCDE", "ABXDEQ", 3, 2, 5, 1), ("XXABCD", "ABXDY", 5, 1, 0, 0),
    ("XXABCDE", "ABXDEYY", 4, 1, 5, 1), ("ZZABC", "ABCQQ", 3, 3, 3, 0),
]


def test_exact_overlap(spark):
    d = spark.createDataFrame([(a.encode(), b.encode(), n) for a, b, n in EXACT] + [(bytes([0xAA, 0, 0xFF, 0x13, 0x7A]), bytes([0, 0xFF, 0x13, 0x7A, 0x55]), 4)], "l binary, r binary, n long")
    assert d.where(exact_overlap("l", "r") != F.col("n")).count() == 0


def test_tolerant_overlap(spark):
    for a, b, m, k, n, miss in TOLERANT:
        d = spark.createDataFrame([(a.encode(), b.encode())], "l binary, r binary")
        r = d.select(tolerant_overlap("l", "r", m, k).alias("x")).first().x
        assert (r.length, r.mismatches, r.matches) == (n, miss, n - miss), (a, b)
        assert r.exact == (n > 0 and miss == 0)
    with pytest.raises(ValueError):
        tolerant_overlap("l", "r", 0, 1)


@pytest.mark.parametrize("least, k", [(1, 0), (2, 0), (3, 0), (4, 1), (7, 2), (9, 0), (3, 3)])
def test_indexed_equals_exhaustive_and_brute(spark, least, k):
    rng = random.Random(least * 10 + k)
    rows = ["", "A", "AA", "AAAA", "AAAA", b"\x00\xff\x80", b"\xff\x80\x7f"]
    source = bytes(rng.choice(b"ABC") for _ in range(160))
    for _ in range(14):
        a = rng.randrange(140)
        piece = bytearray(source[a : a + rng.randrange(1, 40)])
        if rng.random() < 0.4:
            piece[rng.randrange(len(piece))] ^= 3
        rows.append(bytes(piece))
    nodes = fragments(spark, rows)
    got = edge_set(indexed_edges(nodes, least, k))
    assert got == edge_set(exhaustive_edges(nodes, least, k))
    raw = [r if isinstance(r, bytes) else r.encode() for r in rows]
    want = {(i, j): e for i in range(len(raw)) for j in range(len(raw)) if i != j and (e := brute_edge(raw[i], raw[j], least, k))}
    assert {p: (v[0], tuple(d[0] for d in v[4])) for p, v in got.items()} == want


def test_long_fragments(spark):
    rng = random.Random(3)
    source = rng.randbytes(6000)
    nodes = fragments(spark, [source[i : i + 1024] for i in range(0, 5000, 512)])
    got = edge_set(indexed_edges(nodes, 64))
    assert {p: v[0] for p, v in got.items()} == {(i, i + 1): 512 for i in range(9)}


def test_order_degrees_starts(spark):
    nodes = fragments(spark, ["QQABCDEFG", "ABXDEYG", "CDEFGZ", "ABCXEFG"])
    edges = graph.with_paths(indexed_edges(nodes, 5, 2), nodes)
    first = [(r.overlap, r.mismatches) for r in graph.ranked(edges).where("src = 0").orderBy("rank").collect()]
    assert first == [(7, 1), (7, 2), (5, 0)]
    near = graph.adjacency(edges).where("node_id = 0").first().neighbours
    assert [(n.overlap, n.mismatches) for n in near] == first
    complete = fragments(spark, ["AAAA"] * 3)
    e = graph.with_paths(indexed_edges(complete, 1), complete)
    assert e.count() == 6
    deg = graph.degrees(complete, e)
    assert graph.start_nodes(deg).first().node_id == 0
    assert [r.node_id for r in graph.beam_starts(deg).collect()] == [0]
    ties = fragments(spark, ["AAXY", "XY2", "XY1"], ["a", "tie-z", "tie-b"])
    e = graph.with_paths(indexed_edges(ties, 2), ties)
    assert [r.dst for r in graph.top_edges(e, 1).collect()] == [2]


def test_config_and_statistics(spark):
    config = graph.GraphConfig(3, 1, "indexed")
    assert config.approximate_fallback and config.effective_strategy == "exhaustive"
    nodes = fragments(spark, ["ABCDEFGH", "EFXHIJKL", "IJKLMNOP"])
    s = graph.statistics(nodes, graph.build(nodes, config), config).first()
    assert (s.theoretical_pairs, s.edges, s.exact_edges, s.approximate_edges) == (6, 2, 1, 1)
    for bad in ({"min_overlap": 0}, {"max_mismatches": -1}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            graph.GraphConfig(**bad)
