"""Seeded damage of fragment sets, and the order and names in which fragments are emitted.

All randomness is the MD5 of the seed, a purpose, the dataset and a counter, so results don't
depend on partitioning, and SQL elsewhere can repeat them. Truth stays in tables of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragweave.functions.bytes import byte_at, splice


@dataclass(frozen=True)
class DamageConfig:
    """How many fragments to drop, duplicate and invent and how many bytes to corrupt, of each dataset."""

    drop: int = 0
    duplicate: int = 0
    noise: int = 0
    corrupt: int = 0
    seed: int = 0

    def __post_init__(self):
        if min(self.drop, self.duplicate, self.noise, self.corrupt) < 0:
            raise ValueError("counts can't be negative")


def digest(seed: int, purpose: str, *parts: Column | str) -> Column:
    """MD5 in hex of seed:purpose:parts."""
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *cols).cast("binary"))


def draw(seed: int, purpose: str, *parts: Column | str) -> Column:
    """A uniform BIGINT below 2^60."""
    return F.conv(F.substring(digest(seed, purpose, *parts), 1, 15), 16, 10).cast("bigint")


def _demand(ok: Column, message: str) -> Column:
    """true, or an error where a row doesn't hold."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def drop(frags: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(survivors, dropped): k fragments of each dataset leave; the others keep their order."""
    if not k:
        return frags, frags.limit(0)
    w = Window.partitionBy("dataset_id")
    d = frags.withColumn("_k", F.row_number().over(w.orderBy(digest(seed, "drop", "dataset_id", "frag_id"), "frag_id")))
    d = d.withColumn("_n", F.count("*").over(w)).where(_demand(F.col("_n") >= k, "more fragments to drop than there are"))
    return d.where(F.col("_k") > k).drop("_k", "_n"), d.where(F.col("_k") <= k).drop("_k", "_n")


def copy_ids(frags: DataFrame, k: int, seed: int) -> DataFrame:
    """(dataset_id, frag_id, source_frag_id): k copies in each dataset, drawn with replacement, with ids after the largest. No payload moves."""
    w = Window.partitionBy("dataset_id").orderBy("frag_id")
    place = frags.select("dataset_id", F.col("frag_id").alias("source_frag_id"), (F.row_number().over(w) - 1).cast("bigint").alias("_i"))
    size = frags.groupBy("dataset_id").agg(F.count("*").alias("_n"), F.max("frag_id").alias("_max"))
    picks = size.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))) if k else size.limit(0).withColumn("_j", F.lit(0).cast("bigint"))
    picks = picks.withColumn("_i", draw(seed, "duplicate", "dataset_id", "_j") % F.col("_n"))
    return picks.join(place, ["dataset_id", "_i"]).select("dataset_id", (F.col("_max") + 1 + F.col("_j")).alias("frag_id"), "source_frag_id")


def duplicate(frags: DataFrame, k: int, seed: int) -> DataFrame:
    """The copies of copy_ids() with what they copy: dataset_id, frag_id, offset, data, source_frag_id."""
    source = frags.select("dataset_id", F.col("frag_id").alias("source_frag_id"), "offset", "data")
    d = copy_ids(frags, k, seed).join(source, ["dataset_id", "source_frag_id"])
    return d.select("dataset_id", "frag_id", "offset", "data", "source_frag_id")


def noise(survivors: DataFrame, first_id: DataFrame, k: int, seed: int) -> DataFrame:
    """k random fragments in each dataset: sizes uniform between the survivors' least (1 at least) and largest, offset 0.

    first_id: (dataset_id, next_id), the id of the first of them.
    """
    return _noise(_sizes(survivors), first_id, k, seed)


def _sizes(frags: DataFrame) -> DataFrame:
    return frags.select("dataset_id", "frag_id", F.length("data").cast("bigint").alias("size"))


def _noise(sizes: DataFrame, first_id: DataFrame, k: int, seed: int) -> DataFrame:
    """noise() from the survivors' sizes."""
    size = sizes.groupBy("dataset_id").agg(F.min("size").cast("int").alias("_lo"), F.max("size").cast("int").alias("_hi")).join(first_id, "dataset_id")
    if not k:
        return size.limit(0).select("dataset_id", F.lit(0).cast("bigint").alias("frag_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(b"").alias("data"))
    d = size.where(_demand(F.col("_hi") > 0, "noise needs a fragment that isn't empty")).withColumn("_lo", F.greatest(F.lit(1), "_lo"))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    d = d.withColumn("_n", (F.col("_lo") + draw(seed, "noise-size", "dataset_id", "_j") % (F.col("_hi") - F.col("_lo") + 1)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 16).cast("int")), lambda b: digest(seed, "noise", "dataset_id", "_j", b))
    return d.select("dataset_id", (F.col("next_id") + F.col("_j")).alias("frag_id"), F.lit(0).cast("bigint").alias("offset"), F.substr(F.unhex(F.array_join(blocks, "")), F.lit(1), F.col("_n")).alias("data"))


def changed_places(sizes: DataFrame, k: int, seed: int) -> DataFrame:
    """(dataset_id, frag_id, byte_offset, mask): k distinct bytes of each dataset and what changes each by exclusive or.

    sizes: (dataset_id, frag_id, size), so no payload moves. Positions count over the fragments in order of
    id. The j-th lies in the j-th of k equal stretches, at random there, so positions are distinct
    without listing all; the mask is one of 1..255, so the value always changes.
    """
    w = Window.partitionBy("dataset_id").orderBy("frag_id")
    ends = sizes.select("dataset_id", "frag_id", F.col("size").alias("_n"), F.sum("size").over(w).alias("_end"))
    total = ends.groupBy("dataset_id").agg(F.max("_end").alias("_t"))
    if not k:
        picks = total.limit(0).withColumn("_j", F.lit(0).cast("bigint")).withColumn("_pos", F.lit(0).cast("bigint"))
    else:
        edge = lambda j: F.expr(f"(({j}) * _t) div {k}")
        picks = total.where(_demand(F.col("_t") >= k, "more bytes to corrupt than there are")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
        picks = picks.withColumn("_pos", edge("_j") + draw(seed, "corrupt", "dataset_id", "_j") % (edge("_j + 1") - edge("_j")))
    hit = picks.join(ends, "dataset_id").where((F.col("_pos") < F.col("_end")) & (F.col("_pos") >= F.col("_end") - F.col("_n")))
    mask = (1 + draw(seed, "corrupt-value", "dataset_id", "_j") % 255).cast("smallint")
    return hit.select("dataset_id", "frag_id", (F.col("_pos") - F.col("_end") + F.col("_n")).alias("byte_offset"), mask.alias("mask"))


def corruptions(frags: DataFrame, k: int, seed: int) -> DataFrame:
    """The bytes that changed_places() picks: dataset_id, frag_id, byte_offset, original_value, corrupted_value."""
    hit = changed_places(_sizes(frags), k, seed).join(frags.select("dataset_id", "frag_id", "data"), ["dataset_id", "frag_id"])
    old = byte_at("data", (F.col("byte_offset") + 1).cast("int"))
    return hit.select("dataset_id", "frag_id", "byte_offset", old.alias("original_value"), old.bitwiseXOR(F.col("mask")).alias("corrupted_value"))


def apply_corruptions(frags: DataFrame, changes: DataFrame) -> DataFrame:
    """Fragments with the changed bytes; a fragment's changes number at most its bytes."""
    by = changes.groupBy("dataset_id", "frag_id").agg(F.collect_list(F.struct("byte_offset", "corrupted_value")).alias("_c"))
    d = frags.join(by, ["dataset_id", "frag_id"], "left")
    new = F.aggregate("_c", F.col("data"), lambda acc, c: splice(acc, c["byte_offset"].cast("int"), c["corrupted_value"]))
    return d.withColumn("data", F.coalesce(new, F.col("data"))).drop("_c")


@dataclass
class Damage:
    """fragments: dataset_id, frag_id, offset, data, as they are emitted. The rest is truth, for evaluation alone:
    roles (dataset_id, frag_id, role, source_frag_id), changes as from corruptions()."""

    fragments: DataFrame
    roles: DataFrame
    changes: DataFrame


#: Copies and changed bytes of a dataset up to which each of its fragments looks for its own among all of them.
FEW = 64


def _in_place(kept: DataFrame, size: DataFrame, copies: DataFrame, places: DataFrame, made: DataFrame) -> DataFrame:
    """kept with copies, changed bytes and noise, joined by dataset alone: payloads that lie together by dataset_id don't move.

    size: _sizes() of kept; copies: copy_ids(); places: changed_places(); made: noise(). A dataset has few of
    the last three. What it has is one row; the fragment of the least id emits the noise.
    """
    listed = lambda d, name, *cols: d.groupBy("dataset_id").agg(F.collect_list(F.struct(*cols)).alias(name))
    per = size.groupBy("dataset_id").agg(F.min("frag_id").alias("_first"))
    per = per.join(listed(copies, "_copies", "source_frag_id", "frag_id"), "dataset_id", "left")
    per = per.join(listed(places, "_places", "frag_id", "byte_offset", "mask"), "dataset_id", "left")
    per = per.join(listed(made, "_made", "frag_id", "offset", "data"), "dataset_id", "left")
    d = kept.select("dataset_id", "frag_id", "offset", "data").join(per.hint("shuffle_hash"), "dataset_id", "left")

    def change(data, p):
        at = p["byte_offset"].cast("int")
        return splice(data, at, byte_at(data, at + 1).bitwiseXOR(p["mask"]))

    def emitted(frag_id):
        new = F.aggregate(F.filter("_places", lambda p: p["frag_id"] == frag_id), F.col("data"), change)
        return F.struct(frag_id.alias("frag_id"), F.col("offset").alias("offset"), F.coalesce(new, F.col("data")).alias("data"))

    own = F.filter("_copies", lambda c: c["source_frag_id"] == F.col("frag_id"))
    nothing = F.array().cast("array<struct<frag_id:bigint,offset:bigint,data:binary>>")
    all_of = F.concat(
        F.array(emitted(F.col("frag_id"))),
        F.coalesce(F.transform(own, lambda c: emitted(c["frag_id"])), nothing),
        F.when(F.col("frag_id") == F.col("_first"), F.coalesce("_made", nothing)).otherwise(nothing),
    )
    return d.select("dataset_id", F.explode(all_of).alias("x")).select("dataset_id", "x.frag_id", "x.offset", "x.data")


def damage(frags: DataFrame, config: DamageConfig, sizes: DataFrame | None = None) -> Damage:
    """Drop, then duplicate, then noise, then corrupt what isn't noise; copies are made before bytes change.

    sizes: (dataset_id, frag_id, size) of frags, where a plan has them without moving payloads.
    """
    kept, gone = drop(frags, config.drop, config.seed)
    size = drop(_sizes(frags) if sizes is None else sizes, config.drop, config.seed)[0]
    copies = copy_ids(size, config.duplicate, config.seed)
    columns = ["dataset_id", "frag_id", "offset", "data"]
    both = size.unionByName(copies.join(size.withColumnRenamed("frag_id", "source_frag_id"), ["dataset_id", "source_frag_id"]).select("dataset_id", "frag_id", "size"))
    next_id = both.groupBy("dataset_id").agg((F.max("frag_id") + 1).alias("next_id"))
    made = _noise(size, next_id, config.noise, config.seed)
    clean = kept.select(columns).unionByName(duplicate(kept, config.duplicate, config.seed).select(columns))
    changes = corruptions(clean, config.corrupt, config.seed)
    if max(config.duplicate, config.noise, config.corrupt) <= FEW:
        out = _in_place(kept, size, copies, changed_places(both, config.corrupt, config.seed), made)
    else:
        out = apply_corruptions(clean, changes).select(columns).unionByName(made.select(columns))
    role = lambda df, r, source: df.select("dataset_id", "frag_id", F.lit(r).alias("role"), source.cast("bigint").alias("source_frag_id"))
    none = F.lit(None)
    roles = role(size, "original", F.col("frag_id")).unionByName(role(copies, "duplicate", F.col("source_frag_id"))).unionByName(role(made, "noise", none)).unionByName(role(gone, "dropped", F.col("frag_id")))
    return Damage(out, roles, changes)


def shuffled(frags: DataFrame, seed: int) -> DataFrame:
    """Fragments with position, a seeded permutation of each dataset."""
    w = Window.partitionBy("dataset_id").orderBy(digest(seed, "shuffle", "dataset_id", "frag_id"), "frag_id")
    return frags.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def opaque_name(seed: int) -> Column:
    """shard_<16 hex digits>.bin of a dataset_id and a frag_id."""
    return F.concat(F.lit("shard_"), F.substring(digest(seed, "name", "dataset_id", "frag_id"), 1, 16), F.lit(".bin"))


def opaque_names(frags: DataFrame, seed: int) -> DataFrame:
    """Fragments with filename shard_<16 hex digits>.bin; an error if two of a dataset met the same."""
    d = frags.withColumn("filename", opaque_name(seed))
    twice = F.count("*").over(Window.partitionBy("dataset_id", "filename"))
    return d.withColumn("_n", twice).where(_demand(F.col("_n") == 1, "two fragments have one name")).drop("_n")
