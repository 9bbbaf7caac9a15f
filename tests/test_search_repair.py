"""Search, merging, consensus repair, end to end."""

import pytest
from pyspark.sql import functions as F

from fragweave.operators import damage as dmg
from fragweave.operators import repair, search
from fragweave.operators.overlap import indexed_edges
from fragweave.operators.shard import shard
from fragweave.sources.fragments import with_node_ids
from tests.helpers import fragments, steps_with


def greedy(spark, rows, least, k=0, names=None):
    nodes = fragments(spark, rows, names)
    edges = indexed_edges(nodes, least, k)
    steps = search.greedy(nodes, edges)
    out = search.materialise(steps, nodes).first()
    total = search.totals(steps, nodes).first()
    return [r.node_id for r in steps.orderBy("step_no").collect()], bytes(out.data), total


def test_greedy(spark):
    path, data, total = greedy(spark, ["IJKLMNO", "ABCDEFG", "EFGHIJK"], 3)
    assert (path, data, total.complete, total.overlap) == ([1, 2, 0], b"ABCDEFGHIJKLMNO", True, 6)
    path, data, total = greedy(spark, ["ABCDEFG", "EFGHIJK", "ZZZ"], 3)
    assert (data, total.complete, total.n_steps) == (b"ABCDEFGHIJK", False, 2)
    assert greedy(spark, ["XXABCDEF", "CDEFGH", "EFZZ"], 2)[0][1] == 1
    assert greedy(spark, ["ABCDEFG", "EFG"], 3)[1] == b"ABCDEFG"
    assert greedy(spark, ["AAXY", "XY2", "XY1"], 2, names=["a", "tie-z", "tie-b"])[0][:2] == [0, 2]
    path, data, total = greedy(spark, ["XXABCDE", "ABC9EFG", "EFGHI"], 3, 1)
    assert (data, total.complete, total.approximate_joins) == (b"XXABCDEFGHI", True, 1)


def best(spark, rows, least, width):
    nodes = fragments(spark, rows)
    edges = indexed_edges(nodes, least)
    c = search.beam(nodes, edges, width)
    top = c.where("rank = 1")
    return c.orderBy("rank").collect(), bytes(search.materialise(search.steps_of(top, edges), nodes).first().data)


def test_beam(spark):
    rows = ["STARTABC", "ABCEND", "BCMIDXY", "XYTAILAB"]
    assert not best(spark, rows, 2, 1)[0][0].complete
    found, data = best(spark, rows, 2, 2)
    assert found[0].complete and found[0].overlap == 6 and data == b"STARTABCMIDXYTAILABCEND"
    found, _ = best(spark, ["XXABC", "ABCZZ", "BCYY"], 2, 2)
    assert [c.overlap for c in found[:2]] == [3, 2]
    assert best(spark, ["ABCDE", "CDEFG", "ZZZ"], 3, 2)[1] == b"ABCDEFG"
    found, _ = best(spark, ["ABAB", "BABA", "ABAX"], 2, 8)
    assert all(len(set(c.path)) == len(c.path) for c in found)
    one, data = best(spark, ["ONLY"], 1, 1)
    assert one[0].complete and data == b"ONLY"
    with pytest.raises(ValueError):
        search.beam(fragments(spark, ["A"]), None, 0)


def consensus(spark, rows, overlaps):
    nodes, steps = fragments(spark, rows), steps_with(spark, overlaps)
    base = search.materialise(steps, nodes)
    out, pos = repair.consensus(steps, nodes, base)
    return bytes(out.first().data), repair.counters(pos, base).first(), {r.position: r for r in pos.collect()}


def test_consensus(spark):
    data, n, pos = consensus(spark, [b"\x91", b"\xcc", b"\xcc"], [0, 1, 1])
    assert (data, n.repaired, pos[0].support, pos[0].observations) == (b"\xcc", 1, 2, 3)
    data, n, _ = consensus(spark, [b"\x7a", b"\x7a"], [0, 1])
    assert (data, n.redundant, n.corroborated, n.conflicting) == (b"\x7a", 1, 1, 0)
    data, n, pos = consensus(spark, [b"\xcc", b"\x91"], [0, 1])
    assert (data, n.ambiguous, pos[0].observations) == (b"\xcc", 1, 2)
    assert consensus(spark, [b"\xcc", b"\xcc", b"\x91", b"\x91"], [0, 1, 1, 1])[1].ambiguous == 1
    data, n, pos = consensus(spark, [b"\xbb", b"\xaa", b"\xaa", b"\xaa", b"\xbb"], [0, 1, 1, 1, 1])
    assert (data, pos[0].support) == (b"\xaa", 3)
    data, n, _ = consensus(spark, [bytes.fromhex("9122804401")] + [bytes.fromhex("00ff80137a")] * 2, [0, 5, 5])
    assert n.repaired == 4 and data == bytes.fromhex("00ff80137a")
    data, n, _ = consensus(spark, ["ABCDEFGH", "EFGHIJKL", "IJKLMNOP", "MNOPQRST"], [0, 4, 4, 4])
    assert (n.redundant, n.corroborated, n.repaired) == (12, 12, 0)


def test_votes_equal_brute(spark):
    rows = ["ABCDEFGH", "CDXF", "FGHIJKLM", "GH", "HIJKZ"]
    overlaps = [0, 6, 1, 2, 5]
    nodes, steps = fragments(spark, rows), steps_with(spark, overlaps)
    at, start, want = 0, [], {}
    for i, (r, o) in enumerate(zip(rows, overlaps)):
        at = 0 if i == 0 else at + len(rows[i - 1]) - o
        start.append(at)
        for j, c in enumerate(r.encode()):
            want.setdefault(at + j, {}).setdefault(c, 0)
            want[at + j][c] += 1
    places = repair.placements(steps, nodes)
    assert [r.start for r in places.orderBy("step_no").collect()] == start
    got = {}
    for r in repair.votes(places, nodes).collect():
        got.setdefault(r.position, {})[r.value] = r.votes
    assert got == {p: v for p, v in want.items() if sum(v.values()) > 1}


def test_recovers_a_changed_byte(spark):
    source = bytes((i * 73 + 19) & 0xFF for i in range(64))
    frags = shard(spark.createDataFrame([(1, source)], "dataset_id long, data binary"), 16, 12)
    # a byte that several fragments cover, changed in one of them
    changes = spark.createDataFrame([(1, 1, 5, source[9] ^ 0x55)], "dataset_id long, frag_id long, byte_offset long, corrupted_value short")
    broken = dmg.apply_corruptions(frags, changes)
    nodes = with_node_ids(dmg.opaque_names(broken.drop("offset"), 3)).cache()
    edges = indexed_edges(nodes, 12, 1).cache()
    top = search.beam(nodes, edges, 16).where("rank = 1")
    steps = search.steps_of(top, edges).cache()
    out, pos = repair.consensus(steps, nodes, search.materialise(steps, nodes))
    assert bytes(out.first().data) == source
    assert pos.where(F.col("kind") == "repaired").count() <= 1
