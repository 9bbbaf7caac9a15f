"""Components, SimHash groups and embedding groups against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from fragweave.llm import flatgraph, simhash
from fragweave.llm.components import components, spanning
from tests.llm import samples


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        if a != b:
            self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("one_task", [15_000, 0, 20])
def test_components(spark, one_task):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(40)] + [(5, 5), (None, 3), (400, 401), (401, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
    u = Union()
    for a, b in links:
        if a is not None and a != b:
            u.join(a, b)
    assert got.keys() == u.keys()
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(u.top(n))
        assert u.top(r) == u.top(n)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({u.top(n) for n in u})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("chunk", [8192, 5])
def test_simhash_groups(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    data = samples.rows() + samples.ODD
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(samples.table(spark, data)).collect()]
    fp = {}
    for i, t, _ in data:
        fp[i] = slow_fingerprint(t)
    u = Union()
    for a in fp:
        u.top(a)
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                u.join(a, b)
    assert sorted(got) == sorted((i, fp[i], u.top(i)) for i, _, _ in data)
    assert simhash.near_groups(samples.empty(spark)).count() == 0


def test_query_goes_through_tiles(spark, monkeypatch):
    """All groups, small ones too, are compared in tiles; far tile pairs are skipped and none with a link."""
    rng = np.random.default_rng(11)
    low, high = (rng.integers(0, 2, (400, 64)) * (rng.random((400, 64)) < p) for p in (0.2, 1.9))
    fps = np.unique(np.packbits(np.concatenate([low, high]).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64))
    fps = np.unique(np.concatenate([fps, fps[::3] ^ np.uint64(1 << 40)]))
    done = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").coalesce(1)
    got, want = Union(), Union()
    for r in simhash.near_links(table, tally=done).collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3
        got.join(r.a & (2**64 - 1), r.b & (2**64 - 1))
    plain = [int(x) for x in fps]
    for i, a in enumerate(plain):
        for b in plain[:i]:
            if (a ^ b).bit_count() <= 3:
                want.join(a, b)
    assert {x: got.top(x) for x in plain} == {x: want.top(x) for x in plain}
    assert done[0].value > 0 and done[1].value > 0


def test_tile_pairs_that_are_skipped_hold_no_link():
    rng = np.random.default_rng(12)
    x = np.sort(rng.integers(0, 2**64, 3000, dtype=np.uint64) & rng.integers(0, 2**64, 3000, dtype=np.uint64))
    x = x[np.argsort(np.bitwise_count(x), kind="stable")]
    p = np.bitwise_count(x).astype(int)
    pairs = list(simhash.tiles(p, p, True, 3))
    assert {near for _, _, near in pairs} == {True, False} and len(pairs) == 12 * 13 // 2
    for i, j, near in pairs:
        if not near:
            assert np.bitwise_count(x[i : i + simhash.TILE, None] ^ x[None, j : j + simhash.TILE]).min() > 3


def test_tiles_and_chunks():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 63, (300, 2))]]))
    rng.shuffle(x)
    u, v = Union(), Union()
    for i in x.tolist():
        u.top(i)
        v.top(i)
    for i, a in enumerate(x.tolist()):
        for b in x.tolist()[:i]:
            if (a ^ b).bit_count() <= 3:
                u.join(a, b)
    half = len(x) // 2
    parts = [simhash.compare(x[:half], None, 3), simhash.compare(x[half:], None, 3), simhash.compare(x[:half], x[half:], 3)]
    for l, r in parts:
        assert len(l) < len(x)
        for a, b in zip(l.tolist(), r.tolist()):
            assert (a ^ b).bit_count() <= 3
            v.join(a, b)
    assert {i: u.top(i) for i in x.tolist()} == {i: v.top(i) for i in x.tolist()}


@pytest.mark.parametrize("chunk, cluster", [(3000, 1500), (60, 100)])
def test_embedding_groups(spark, chunk, cluster):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 16))
    for k in range(40):
        x[100 + 5 * k : 103 + 5 * k] = x[k] + rng.standard_normal((3, 16)) * 0.1
    x[480:490] = x[0]
    x[490] = 3 * x[1]
    data = [(i, [float(z) for z in v]) for i, v in enumerate(x.astype(np.float32))]
    got = {r.vec_id: r for r in flatgraph.near_groups(spark.createDataFrame(data, "vec_id long, embedding array<float>"), chunk=chunk, cluster=cluster).collect()}
    y = flatgraph.unit(x.astype(np.float32).astype(float))
    near = y @ y.T >= 0.95
    u = Union()
    for i in range(500):
        u.top(i)
        for j in np.flatnonzero(near[i]):
            u.join(i, int(j))
    true = near.sum() - 500
    found = sum(r.n_links for r in got.values())
    assert 0.97 * true <= found <= true
    assert all(got[i].n_links <= near[i].sum() - 1 for i in got)
    assert sum(got[i].component_id == u.top(i) for i in got) >= 495
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, id long, v string"
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, None]), (8, []), (9, [float("inf"), 0.0]), (10, [1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flatgraph.near_groups(spark.createDataFrame([(*r, 0, 0, "") for r in data], kind)).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False)} | {i: (0, i, True) for i in range(3, 10)}
    assert flatgraph.near_groups(spark.createDataFrame([], kind)).count() == 0


def dense_groups(rng, dim=64, size=60):
    """Two groups of distinct vectors, nearer to their own than to each other, all within 0.95 of all others."""
    base, other = flatgraph.unit(rng.standard_normal((2, dim)))
    centers = flatgraph.unit(np.stack([base, base + 0.22 * flatgraph.unit((other - (other @ base) * base)[None])[0]]))
    return flatgraph.unit(np.concatenate([c + 0.003 * rng.standard_normal((size, dim)) for c in centers]))


@pytest.mark.parametrize("chunk", [3000, 60])
def test_dense_groups_in_range_of_each_other_are_whole(spark, chunk):
    x = np.concatenate([dense_groups(np.random.default_rng(5)), flatgraph.unit(np.random.default_rng(6).standard_normal((80, 64)))])
    near = (x @ x.T >= 0.95).sum(1) - 1
    assert near[:120].min() == 119
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in flatgraph.near_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>"), chunk=chunk, cluster=40).collect()}
    assert [got[i].n_links for i in range(200)] == near.tolist()
    assert {got[i].component_id for i in range(120)} == {0}


def test_a_pair_counts_in_its_first_common_shard_only(monkeypatch):
    """What the search misses, here all, each shard's check adds, and one shard counts the pair."""
    nothing = np.zeros(0, np.int64)
    monkeypatch.setattr(flatgraph, "search", lambda *a: (nothing, nothing))
    v = [x.astype("<f8").tobytes() for x in flatgraph.unit(np.array([[1.0, 0.1], [1.0, 0.0], [0.0, 1.0]]))]
    rows = pd.DataFrame({"id": [1, 2, 5], "n": [1, 3, 1], "v": v, "probe": [False, False, False], "near": [["2:0", "2:1"], ["2:0", "2:1"], ["2:1"]], "core": None, "adj": [[], [], []], "is_node": True, "is_query": True})
    run = flatgraph._searcher(0.95)
    first, second = (run((c, 0, 0), rows) for c in ("2:0", "2:1"))
    assert first.dropna(subset=["id"])[["id", "links"]].to_numpy().tolist() == [[1, 3], [2, 1]]
    assert first.dropna(subset=["a"])[["a", "b"]].to_numpy().tolist() == [[1, 2]]
    assert second["id"].isna().all() and second["a"].isna().all()
    assert first["found"].sum() == 0 and first["there"].sum() == 1


def groups_and_noise(rng, n, dim=32, groups=40, size=4):
    x = rng.standard_normal((n, dim))
    for g in range(groups):
        x[size * g + 1 : size * (g + 1)] = x[size * g] + rng.standard_normal((size - 1, dim)) * 0.08
    return flatgraph.unit(x)


def table_of(spark, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def truth_of(x):
    near = x @ x.T >= 0.95
    u = Union()
    for i, j in zip(*np.nonzero(near)):
        u.join(int(i), int(j))
    return near.sum(1) - 1, [u.top(i) for i in range(len(x))]


def test_copies_of_a_vector_do_not_grow_with_the_data(spark, monkeypatch):
    """Clusters are divided again as the data grow, since their first number is bounded by the sample."""
    monkeypatch.setattr(flatgraph, "SAMPLE", 400)
    monkeypatch.setattr(flatgraph, "SUB_SAMPLE", 300)
    copies = []
    for n in (3000, 12_000):
        x = groups_and_noise(np.random.default_rng(8), n)
        report = {}
        got = {r.vec_id: (r.n_links, r.component_id) for r in flatgraph.near_groups(table_of(spark, x), chunk=200, cluster=100, report=report).collect()}
        links, top = truth_of(x)
        right = sum(got[i] == (links[i], top[i]) for i in range(160))
        assert report["recall"] >= 0.9 and report["shard_recall"] > 0.95 and right >= 0.9 * 160
        assert all(got[i][0] <= links[i] for i in range(n))
        copies.append(report["copies"] / report["overlap"])
    assert max(copies) <= 4.2 and copies[1] <= 1.5 * copies[0] + 0.5


def test_a_dense_group_of_many_chunks_is_whole(spark, monkeypatch):
    """One group of 500 vectors, part of it core, and others near its edge, over chunks of 60."""
    monkeypatch.setattr(flatgraph, "SUB_SAMPLE", 300)
    rng = np.random.default_rng(9)
    base = flatgraph.unit(rng.standard_normal((1, 32)))
    near = flatgraph.unit(base + rng.standard_normal((500, 32)) * rng.uniform(0.005, 0.045, (500, 1)))
    x = np.concatenate([near, groups_and_noise(rng, 400, groups=20)])
    links, top = truth_of(x)
    assert 0 < (links[:500] < 490).sum() < 500
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in flatgraph.near_groups(table_of(spark, x), chunk=60, cluster=50, report=report).collect()}
    assert sum(got[i] == (links[i], top[i]) for i in range(len(x))) >= len(x) - 8
    assert sum(got[i][0] for i in range(500)) >= 0.999 * links[:500].sum()


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(flatgraph, "_truth", lambda probes, t: lambda batches: iter([pd.DataFrame({"probe": [0], "there": [100_000]})]))
    with pytest.raises(RuntimeError, match="recall"):
        flatgraph.near_groups(table_of(spark, groups_and_noise(np.random.default_rng(1), 200))).count()


def test_spanning():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 50, 400)
    u, v = Union(), Union()
    for x, y in zip(a.tolist(), b.tolist()):
        u.join(x, y)
    picked = spanning(a, b, 50)
    for i in picked:
        assert v.top(int(a[i])) != v.top(int(b[i]))
        v.join(int(a[i]), int(b[i]))
    assert all(u.top(i) == v.top(i) for i in range(50))
