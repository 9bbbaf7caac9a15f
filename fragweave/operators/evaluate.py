"""Recovery metrics against ground truth. Truth tables meet the recovered ones here and nowhere else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragweave.functions.bytes import rate
from fragweave.session import cut_lineage


def selected(steps: DataFrame, emissions: DataFrame, roles: DataFrame, originals: DataFrame) -> DataFrame:
    """Steps with truth: role, source_id, offset and size of surviving originals (null for others).

    emissions: (dataset_id, node_id, frag_id). A step without an emission or with an unknown role is an error.
    """
    d = steps.join(emissions.select("dataset_id", "node_id", "frag_id"), ["dataset_id", "node_id"], "left")
    d = d.join(roles.where("role <> 'dropped'").select("dataset_id", "frag_id", "role", F.col("source_frag_id").alias("source_id")), ["dataset_id", "frag_id"], "left")
    bad = F.raise_error(F.lit("a selected fragment has no ground truth")).cast("string")
    d = d.withColumn("role", F.when(F.col("role").isNull(), bad).otherwise(F.col("role")))
    o = originals.select("dataset_id", "frag_id", F.col("offset").alias("o"), F.length("data").cast("bigint").alias("s"))
    d = d.join(o, ["dataset_id", "frag_id"], "left")
    own = F.col("role") == "original"
    return d.withColumn("true_offset", F.when(own, F.col("o"))).withColumn("true_size", F.when(own, F.col("s"))).drop("o", "s")


def _ordered(offsets: np.ndarray) -> tuple[int, int]:
    """Comparable and ordered pairs of one path, by a Fenwick tree over offsets: n log n, not all pairs."""
    values, place = np.unique(offsets, return_inverse=True)
    tree, ordered = [0] * (len(values) + 1), 0
    for p in place.tolist():
        k = p
        while k > 0:  # earlier steps with a smaller offset
            ordered += tree[k]
            k &= k - 1
        k = p + 1
        while k < len(tree):
            tree[k] += 1
            k += k & -k
    same = np.bincount(place, minlength=1)
    n = len(offsets)
    return n * (n - 1) // 2 - int((same * (same - 1) // 2).sum()), ordered


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [_ordered(np.asarray(x)) for x in pdf["offs"]]
        yield pd.DataFrame({"dataset_id": pdf["dataset_id"], "comparable": [f[0] for f in found], "ordered": [f[1] for f in found]})


def order_pairs(sel: DataFrame) -> DataFrame:
    """(dataset_id, comparable, ordered): pairs of genuine originals in path order whose offsets differ, and those in order of offset.

    A path visits a fragment once, so sources always differ. Steps hold no payload.
    """
    o = sel.where("role = 'original'").groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("step_no", "true_offset"))).alias("x"))
    o = o.select("dataset_id", F.transform("x", lambda v: v["true_offset"]).alias("offs"))
    return o.mapInPandas(_pairs, f"dataset_id {dict(sel.dtypes)['dataset_id']}, comparable long, ordered long")


def joins(sel: DataFrame) -> DataFrame:
    """(dataset_id, genuine, consistent) joins between neighbouring steps that are both surviving originals."""
    w = Window.partitionBy("dataset_id").orderBy("step_no")
    d = sel.withColumn("po", F.lag("true_offset").over(w)).withColumn("ps", F.lag("true_size").over(w))
    d = d.where("po is not null and true_offset is not null")
    return d.groupBy("dataset_id").agg(F.count("*").alias("genuine"), F.count_if(F.col("true_offset") == F.col("po") + F.col("ps") - F.col("overlap_from_previous")).alias("consistent"))


def metrics(original: DataFrame, final: DataFrame, steps: DataFrame, emissions: DataFrame, roles: DataFrame, originals: DataFrame, repair_events: DataFrame | None = None) -> DataFrame:
    """A row per dataset of original (dataset_id, data): exactness, sizes, roles of the selected fragments, order, joins, rates.

    Rates over nothing are null. final: (dataset_id, data); repair_events: (dataset_id, repair_events).
    """
    # both are read several times below, and roles come from the whole chain of damage
    roles = cut_lineage(roles)
    sel = cut_lineage(selected(steps, emissions, roles, originals))
    by = sel.groupBy("dataset_id").agg(
        F.count_if(F.col("role") == "original").alias("selected_originals"),
        F.count_if(F.col("role") == "duplicate").alias("selected_duplicates"),
        F.count_if(F.col("role") == "noise").alias("selected_noise"),
    )
    alive = roles.where("role = 'original'").select("dataset_id", F.col("frag_id").alias("source_id"))
    there = sel.where("role <> 'noise'").select("dataset_id", "source_id").distinct().join(alive, ["dataset_id", "source_id"], "left_semi").groupBy("dataset_id").agg(F.count("*").alias("represented"))
    emitted = roles.groupBy("dataset_id").agg(F.count_if(F.col("role") == "original").alias("surviving"), F.count_if(F.col("role") == "noise").alias("emitted_noise"))
    # outputs are told apart by size and SHA-256, so that neither payload moves
    told = lambda df, size, mark: df.select("dataset_id", F.length("data").cast("bigint").alias(size), F.sha2("data", 256).alias(mark))
    d = told(original, "original_bytes", "o").join(told(final, "reconstructed_bytes", "f"), "dataset_id", "left")
    d = d.withColumn("reconstructed_bytes", F.coalesce("reconstructed_bytes", F.lit(0).cast("bigint"))).withColumn("f", F.coalesce("f", F.sha2(F.lit(b""), 256)))
    d = d.select("dataset_id", ((F.col("original_bytes") == F.col("reconstructed_bytes")) & (F.col("o") == F.col("f"))).alias("exact_recovery"), "original_bytes", "reconstructed_bytes")
    d = d.withColumn("size_delta", F.col("reconstructed_bytes") - F.col("original_bytes"))
    parts = [by, there, emitted, order_pairs(sel), joins(sel)] + ([repair_events] if repair_events is not None else [])
    for p in parts:
        d = d.join(p, "dataset_id", "left")
    d = d.na.fill(0).withColumn("inconsistent", F.col("genuine") - F.col("consistent"))
    return d.withColumn("recall", rate("represented", "surviving")).withColumn("noise_rate", rate("selected_noise", "emitted_noise")).withColumn("order_accuracy", rate("ordered", "comparable"))


def aggregate(m: DataFrame) -> DataFrame:
    """One row over all runs: rates are means over the runs that have one, noise over all.

    Rates are summed as decimals, so that means don't depend on the order of runs.
    """
    mean = lambda c: F.avg(F.col(c).cast("decimal(38,20)")).cast("double")
    return m.agg(
        F.count("*").alias("runs"),
        F.count_if("exact_recovery").alias("exact_runs"),
        mean("recall").alias("mean_recall"),
        mean("order_accuracy").alias("mean_order_accuracy"),
        F.avg("selected_noise").alias("mean_selected_noise"),
    )
