"""Sharding and damage against the fixtures and their invariants."""

import pytest
from pyspark.sql import functions as F

from fragweave.operators import damage as dmg
from fragweave.operators.shard import filenames, shard


def payload(spark, n, ds=1):
    return spark.createDataFrame([(ds, bytes(i % 256 for i in range(n)))], "dataset_id long, data binary")


@pytest.mark.parametrize(
    "n, size, overlap, offsets, sizes",
    [
        (16, 4, 0, [0, 4, 8, 12], [4] * 4),
        (11, 8, 4, [0, 4], [8, 7]),
        (5, 100, 20, [0], [5]),
        (20, 8, 4, [0, 4, 8, 12], [8] * 4),
        (10, 8, 7, [0, 1, 2], [8] * 3),
        (6, 1, 0, [0, 1, 2, 3, 4, 5], [1] * 6),
        (0, 8, 4, [], []),
    ],
)
def test_offsets_and_sizes(spark, n, size, overlap, offsets, sizes):
    rows = shard(payload(spark, n), size, overlap).orderBy("frag_id").collect()
    assert [r.offset for r in rows] == offsets
    assert [len(r.data) for r in rows] == sizes
    assert all(r.data == bytes(i % 256 for i in range(r.offset, r.offset + len(r.data))) for r in rows)


@pytest.mark.parametrize("size, overlap", [(0, 0), (4, 4), (4, 5)])
def test_bad_sizes(spark, size, overlap):
    with pytest.raises(ValueError):
        shard(payload(spark, 8), size, overlap)


def test_filenames_widen(spark):
    d = filenames(shard(payload(spark, 20), 8, 4)).orderBy("frag_id")
    assert [r.filename for r in d.collect()] == [f"fragment_{i:04d}.bin" for i in range(4)]


def test_damage_invariants(spark):
    frags = shard(payload(spark, 100), 16, 4)
    before = {r.frag_id: bytes(r.data) for r in frags.collect()}
    config = dmg.DamageConfig(drop=1, duplicate=2, noise=3, corrupt=5, seed=42)
    got = dmg.damage(frags, config)
    after = {r.frag_id: bytes(r.data) for r in got.fragments.collect()}
    roles = {r.frag_id: (r.role, r.source_frag_id) for r in got.roles.collect()}
    changes = got.changes.collect()
    assert len(after) == len(before) - 1 + 2 + 3
    assert sum(r == "dropped" for r, _ in roles.values()) == 1
    assert len(changes) == 5 and len({(c.frag_id, c.byte_offset) for c in changes}) == 5
    assert all(c.original_value != c.corrupted_value for c in changes)
    assert all(roles[c.frag_id][0] != "noise" for c in changes)
    for f, (role, source) in roles.items():
        if role in ("original", "duplicate"):
            want = bytearray(before[source])
            for c in changes:
                if c.frag_id == f:
                    assert want[c.byte_offset] == c.original_value
                    want[c.byte_offset] = c.corrupted_value
            assert after[f] == bytes(want)
        if role == "noise":
            alive = [len(before[k]) for k, (r, _) in roles.items() if r == "original"]
            assert max(1, min(alive)) <= len(after[f]) <= max(alive)
    again = dmg.damage(frags.repartition(3), config)
    assert {r.frag_id: bytes(r.data) for r in again.fragments.collect()} == after


def test_damage_errors(spark):
    frags = shard(payload(spark, 8), 4)
    with pytest.raises(Exception, match="more fragments to drop"):
        dmg.drop(frags, 3, 1)[0].collect()
    with pytest.raises(Exception, match="more bytes to corrupt"):
        dmg.corruptions(frags, 9, 1).collect()
    with pytest.raises(ValueError):
        dmg.DamageConfig(drop=-1)


def test_names_and_order(spark):
    frags = spark.range(1000).select(F.lit(1).cast("long").alias("dataset_id"), F.col("id").alias("frag_id"), F.lit(b"x").alias("data"))
    d = dmg.shuffled(dmg.opaque_names(frags, 5), 5).collect()
    assert len({r.filename for r in d}) == 1000 and all(len(r.filename) == 26 for r in d)
    assert sorted(r.position for r in d) == list(range(1000))
    assert [r.frag_id for r in sorted(d, key=lambda r: r.position)] != list(range(1000))
