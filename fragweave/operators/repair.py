"""Consensus repair: placements, votes by position, strict majorities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragweave.functions.bytes import chars, hex_byte
from fragweave.session import cut_lineage


def placements(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dataset_id, step_no, node_id, start, size): where each step's fragment lies in the output; a running sum."""
    d = steps.select("dataset_id", "step_no", "node_id", "overlap_from_previous").join(nodes.select("dataset_id", "node_id", F.length("data").cast("bigint").alias("size")), ["dataset_id", "node_id"])
    w = Window.partitionBy("dataset_id").orderBy("step_no")
    ahead = F.coalesce(F.lag("size").over(w), F.lit(0)) - F.col("overlap_from_previous")
    d = d.withColumn("_ahead", F.when(F.col("step_no") == 0, 0).otherwise(ahead))
    return d.select("dataset_id", "step_no", "node_id", F.sum("_ahead").over(w).cast("bigint").alias("start"), "size")


#: Output bytes of a block; a block's slices are voted on together.
BLOCK = 1024


def _slices(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dataset_id, block, at, part, n, first): the stretches of fragments in each block of the output, equal ones counted.

    Each fragment gives the bytes that an earlier one can reach over or a later one begins before;
    bytes that only it covers never move. A block's rows lie in one partition. first: the earliest step that has it.
    """
    w = Window.partitionBy("dataset_id").orderBy("step_no")
    end = F.col("start") + F.col("size")
    d = places.withColumn("_before", F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_after", F.coalesce(F.min("start").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1 << 62)))
    # [start, head) is covered before, [tail, end) after; if they meet, all of it
    d = d.withColumn("_head", F.greatest(F.col("start"), F.least(end, F.col("_before")))).withColumn("_tail", F.greatest("_head", F.least(end, F.col("_after"))))
    d = d.where((F.col("_head") > F.col("start")) | (F.col("_tail") < end))
    d = d.join(nodes.select("dataset_id", "node_id", "data"), ["dataset_id", "node_id"])
    d = d.withColumn("x", F.explode(F.array(F.struct(F.col("start").alias("a"), F.col("_head").alias("b")), F.struct(F.col("_tail").alias("a"), end.alias("b"))))).where("x.b > x.a")
    d = d.withColumn("block", F.explode(F.sequence(F.expr(f"x.a div {BLOCK}"), F.expr(f"(x.b - 1) div {BLOCK}"))))
    at = F.greatest(F.col("x.a"), F.col("block") * BLOCK)
    stop = F.least(F.col("x.b"), (F.col("block") + 1) * BLOCK)
    part = F.substr("data", (at - F.col("start") + 1).cast("int"), (stop - at).cast("int"))
    d = d.select("dataset_id", "block", at.alias("at"), part.alias("part"), "step_no").repartition("dataset_id", "block")
    return d.groupBy("dataset_id", "block", "at", "part").agg(F.count("*").alias("n"), F.min("step_no").alias("first"))


def _blocks(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dataset_id, block, slices)."""
    return _slices(places, nodes).groupBy("dataset_id", "block").agg(F.collect_list(F.struct("at", "part", "n", "first")).alias("slices"))


def _table(found: list[tuple]) -> pd.DataFrame:
    ds, *columns = zip(*found)
    return pd.DataFrame({"dataset_id": [x for d in ds for x in d]} | dict(zip(("position", "value", "votes"), map(np.concatenate, columns))))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of slices to the votes of each value at positions that two or more fragments cover."""
    for pdf in batches:
        found, rows = [], 0
        for ds, block, slices in zip(pdf["dataset_id"], pdf["block"], pdf["slices"]):
            votes = np.zeros((BLOCK, 256), np.int64)
            for s in slices:
                a, data = int(s["at"]) - int(block) * BLOCK, np.frombuffer(s["part"], np.uint8)
                votes[np.arange(a, a + len(data)), data] += s["n"]
            p, v = np.nonzero(votes * (votes.sum(1, keepdims=True) >= 2))
            found.append(([ds] * len(p), p + int(block) * BLOCK, v.astype(np.int16), votes[p, v]))
            rows += len(p)
            if rows > 200_000:
                yield _table(found)
                found, rows = [], 0
        if found:
            yield _table(found)


def votes(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dataset_id, position, value, votes) of the positions that two or more fragments cover, counted block by block."""
    return _blocks(places, nodes).mapInPandas(_count, f"dataset_id {dict(places.dtypes)['dataset_id']}, position long, value short, votes long")


_POSITION = "position long, length long, observations long, distinct_values long, support long, before smallint, after smallint, votes array<struct<value:smallint,votes:bigint>>, kind string"


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of slices to their voted positions: a row for each that has several values, and one for each stretch that has one."""
    for pdf in batches:
        rows = []
        for ds, block, slices in zip(pdf["dataset_id"], pdf["block"], pdf["slices"]):
            slices = sorted(slices, key=lambda s: s["first"])
            if len(slices) == 1 and slices[0]["n"] < 2:
                continue
            begin = int(block) * BLOCK
            cover, base = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.uint8)
            split = np.zeros(BLOCK, bool)
            held = []
            for s in slices:
                a, data = int(s["at"]) - begin, np.frombuffer(s["part"], np.uint8)
                z = slice(a, a + len(data))
                new = cover[z] == 0
                base[z][new] = data[new]  # the earliest step's byte is that of the merged output
                split[z] |= base[z] != data
                cover[z] += s["n"]
                held.append((a, data, int(s["n"])))
            for p in np.flatnonzero(split).tolist():
                count: dict[int, int] = {}
                for a, data, n in held:
                    if 0 <= p - a < len(data):
                        v = int(data[p - a])
                        count[v] = count.get(v, 0) + n
                seen, before = int(cover[p]), int(base[p])
                win = max(count, key=lambda v: (count[v], -v))
                wins = 2 * count[win] > seen
                kind = "ambiguous" if not wins else "repaired" if win != before else "corroborated"
                rows.append((ds, begin + p, 1, seen, len(count), count[win], before, win if wins else before, [{"value": v, "votes": count[v]} for v in sorted(count)], kind))
            agreed = np.concatenate([[False], (cover > 1) & ~split, [False]])
            edges = np.flatnonzero(agreed[1:] != agreed[:-1])
            rows += [(ds, begin + int(i), int(j - i), None, 1, None, None, None, None, "corroborated") for i, j in zip(edges[::2], edges[1::2])]
        out = pd.DataFrame(rows, columns=["dataset_id", *(c.split()[0] for c in re.split(r", (?![^<]*>)", _POSITION))])
        yield out.astype({c: "Int64" for c in ("position", "length", "observations", "distinct_values", "support", "before", "after")})


def positions(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positions with two or more observations: position, length, observations, distinct values, winner and its support, all votes,
    the byte before and after, and kind: corroborated, repaired or ambiguous.

    A value wins with more than half of the observations. Without a winner the byte stays. A position
    with several values is a row of length 1; a stretch of a block that has one value everywhere is
    one row of its length, without the figures of a single position. Slices of a block that many
    fragments have alike are counted before they are gathered, so a block holds different ones only.
    """
    return _blocks(places, nodes).mapInPandas(_vote, f"dataset_id {dict(places.dtypes)['dataset_id']}, {_POSITION}")


def repairs(pos: DataFrame) -> DataFrame:
    """Changed bytes: dataset_id, position, before, after, support, observations."""
    return pos.where("kind = 'repaired'").select("dataset_id", "position", "before", "after", "support", "observations")


def ambiguities(pos: DataFrame) -> DataFrame:
    """Bytes without a majority: dataset_id, position, before, observations, votes."""
    return pos.where("kind = 'ambiguous'").select("dataset_id", "position", "before", "observations", "votes")


def counters(pos: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row per dataset: redundant, conflicting (repaired ones too), corroborated (unanimous ones too), repaired, ambiguous positions."""
    total = lambda when, name: F.sum(F.when(when, F.col("length")).otherwise(0)).alias(name)
    c = pos.groupBy("dataset_id").agg(F.sum("length").alias("redundant"), total(F.col("distinct_values") > 1, "conflicting"), *[total(F.col("kind") == k, k) for k in ("corroborated", "repaired", "ambiguous")])
    return baseline.select("dataset_id").join(c, "dataset_id", "left").na.fill(0)


def apply(baseline: DataFrame, changes: DataFrame) -> DataFrame:
    """(dataset_id, data) with bytes replaced; changes: (dataset_id, position, after). One pass over each payload that changes."""
    by = changes.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.struct("position", F.hex(F.col("after").cast("bigint")).alias("h")))).alias("_m"))
    d = baseline.select("dataset_id", "data").join(by, "dataset_id", "left")
    at = F.transform(chars("data"), lambda c, i: F.coalesce(F.try_element_at("_m", i.cast("bigint")), F.hex(F.ascii(c).cast("bigint"))))
    new = F.unhex(F.array_join(F.transform(at, lambda h: F.lpad(h, 2, "0")), ""))
    return d.select("dataset_id", F.when(F.col("_m").isNull(), F.col("data")).otherwise(new).alias("data"))


def vote_text(votes: str = "votes"):
    """hh:n,hh:n of an array of (value, votes)."""
    return F.array_join(F.transform(votes, lambda v: F.concat(hex_byte(v["value"]), F.lit(":"), v["votes"].cast("string"))), ",")


def consensus(steps: DataFrame, nodes: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired payloads, positions) of each dataset's path."""
    pos = cut_lineage(positions(placements(steps, nodes), nodes))
    return apply(baseline, repairs(pos)), pos
