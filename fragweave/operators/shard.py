"""Sharding: a payload to overlapping fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_of(n: Column, size: int, overlap: int) -> Column:
    """Fragments of n bytes: none of an empty payload, else up to the first that reaches the end."""
    return F.when(n == 0, 0).otherwise(1 + F.ceil(F.greatest(F.lit(0), n - size) / F.lit(size - overlap))).cast("bigint")


def shard(payloads: DataFrame, size: int, overlap: int = 0, data: str = "data") -> DataFrame:
    """(dataset_id, data) -> (dataset_id, frag_id, offset, data). A narrow plan: one explode, no shuffle.

    size 0 and an overlap not below the size are errors; empty and null payloads give no rows.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("a fragment's size has to be positive and larger than the overlap")
    stride = size - overlap
    n = F.length(data)
    d = payloads.withColumn("_count", count_of(n, size, overlap)).where("_count > 0")
    d = d.withColumn("frag_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1)))
    d = d.withColumn("offset", F.col("frag_id") * stride)
    return d.select("dataset_id", "frag_id", "offset", F.substr(F.col(data), (F.col("offset") + 1).cast("int"), F.lit(size)).alias("data"))


def filenames(frags: DataFrame) -> DataFrame:
    """With filename fragment_0000.bin, as wide as the last id needs, four digits at least."""
    last = frags.groupBy("dataset_id").agg(F.greatest(F.lit(4), F.length(F.max("frag_id").cast("string"))).alias("_w"))
    d = frags.join(last, "dataset_id")
    return d.withColumn("filename", F.concat(F.lit("fragment_"), F.lpad(F.col("frag_id").cast("string"), F.col("_w"), F.lit("0")), F.lit(".bin"))).drop("_w")
