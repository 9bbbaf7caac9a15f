"""PNG structure: chunks, issues, validity, ranking evidence, checksum-guided repair.

A chunk's place depends on the lengths of all before it, so a file is walked by an Arrow-batched
Python function, one row in, one row out; everything after that is DataFrame work.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.functions.bytes import byte_at, hex_byte, splice
from fragweave.operators import search

# The PNG signature, the issue codes in order (the first 14 are structural), the semantic ones, the depths of each colour type, the messages.
SIGNATURE = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])
CODES = (
    "invalid_signature truncated_chunk_header truncated_chunk invalid_chunk_type ihdr_not_first missing_ihdr duplicate_ihdr invalid_ihdr_length invalid_dimensions "
    "missing_idat missing_iend duplicate_iend invalid_iend_length trailing_data crc_mismatch invalid_compression_method invalid_filter_method invalid_interlace_method "
    "invalid_color_type_bit_depth nonconsecutive_idat"
).split()
STRUCTURAL = 13
SEMANTIC = {"invalid_compression_method", "invalid_filter_method", "invalid_interlace_method", "invalid_color_type_bit_depth", "nonconsecutive_idat"}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
MESSAGES = {
    "invalid_signature": "Invalid or truncated PNG signature",
    "truncated_chunk_header": "Truncated PNG chunk length or type",
    "truncated_chunk": "Declared PNG chunk extends beyond input",
    "invalid_chunk_type": "PNG chunk type must contain only ASCII letters",
    "ihdr_not_first": "IHDR must be the first chunk",
    "missing_ihdr": "PNG is missing IHDR",
    "duplicate_ihdr": "PNG contains duplicate IHDR",
    "invalid_ihdr_length": "IHDR length must be 13",
    "invalid_dimensions": "PNG width and height must be nonzero",
    "missing_idat": "PNG is missing IDAT",
    "missing_iend": "PNG is missing IEND",
    "invalid_iend_length": "IEND length must be zero",
    "trailing_data": "Unexpected bytes follow IEND",
    "crc_mismatch": "PNG chunk CRC does not match its type and data",
    "invalid_compression_method": "PNG compression method must be zero",
    "invalid_filter_method": "PNG filter method must be zero",
    "invalid_interlace_method": "PNG interlace method must be zero or one",
    "invalid_color_type_bit_depth": "PNG color type and bit depth combination is invalid",
    "nonconsecutive_idat": "PNG IDAT chunks must be consecutive",
}
OUTSIDE = "position is outside CRC-covered PNG chunk type/data"
SEVERAL = "multiple ambiguous positions occur in the same PNG chunk"
NO_MATCH = "no observed candidate matches the stored PNG CRC"
MATCHES = "multiple observed candidates match the stored PNG CRC"

CHUNK = "struct<idx:int,offset:bigint,length:bigint,type:string,stored_crc:bigint,computed_crc:bigint,crc_valid:boolean>"
ISSUE = "struct<code:string,code_ord:int,offset:bigint,message:string>"
IHDR = "struct<width:bigint,height:bigint,bit_depth:smallint,color_type:smallint,compression_method:smallint,filter_method:smallint,interlace_method:smallint>"


def walk(data: bytes) -> tuple[bool, bool, list[tuple], tuple | None, list[tuple]]:
    """(signature valid, walked to the end, chunks, last readable header, issues as (code, offset)) of a file."""
    if not data.startswith(SIGNATURE):
        return False, False, [], None, [("invalid_signature", 0)]
    chunks: list[tuple] = []
    issues: list[tuple] = []
    header, whole, at, n = None, True, len(SIGNATURE), len(data)
    tags: list[bytes] = []
    while at < n:
        if n - at < 8:
            issues.append(("truncated_chunk_header", at))
            whole = False
            break
        (length,), tag = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if not (tag.isalpha() and tag.isascii()):
            issues.append(("invalid_chunk_type", at + 4))
        end = at + 12 + length
        if end > n:
            issues.append(("truncated_chunk", at))
            whole = False
            break
        body = data[at + 8 : end - 4]
        (stored,) = struct.unpack_from(">I", data, end - 4)
        computed = zlib.crc32(body, zlib.crc32(tag))
        chunks.append((len(chunks), at, length, tag.decode("latin-1"), stored, computed, stored == computed))
        if stored != computed:
            issues.append(("crc_mismatch", at))
        if not tags and tag != b"IHDR":
            issues.append(("ihdr_not_first", at))
        if tag == b"IHDR":
            if b"IHDR" in tags:
                issues.append(("duplicate_ihdr", at))
            if length != 13:
                issues.append(("invalid_ihdr_length", at))
            else:
                header = struct.unpack(">IIBBBBB", body)
                width, height, depth, colour, compression, filters, interlace = header
                wrong = (
                    ("invalid_dimensions", not width or not height),
                    ("invalid_compression_method", compression != 0),
                    ("invalid_filter_method", filters != 0),
                    ("invalid_interlace_method", interlace > 1),
                    ("invalid_color_type_bit_depth", depth not in DEPTHS.get(colour, ())),
                )
                issues += [(code, at) for code, bad in wrong if bad]
        # an IDAT after another chunk that itself came after an IDAT
        if tag == b"IDAT" and b"IDAT" in tags and any(t != b"IDAT" for t in tags[tags.index(b"IDAT") :]):
            issues.append(("nonconsecutive_idat", at))
        tags.append(tag)
        at = end
        if tag == b"IEND":
            if length:
                issues.append(("invalid_iend_length", end - 12 - length))
            if at != n:
                issues.append(("trailing_data", at))
            break
    for tag, code, where in ((b"IHDR", "missing_ihdr", 8), (b"IDAT", "missing_idat", 8), (b"IEND", "missing_iend", n)):
        if tag not in tags:
            issues.append((code, where))
    return True, whole, chunks, header, issues


def _analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place = {c: i for i, c in enumerate(CODES)}
    names = ("idx", "offset", "length", "type", "stored_crc", "computed_crc", "crc_valid")
    fields = ("width", "height", "bit_depth", "color_type", "compression_method", "filter_method", "interlace_method")
    for pdf in batches:
        rows = []
        for key, data in zip(pdf["dataset_id"], pdf["data"]):
            signature, whole, chunks, header, issues = walk(bytes(data or b""))
            found = [{"code": c, "code_ord": place[c], "offset": o, "message": MESSAGES[c]} for c, o in issues]
            rows.append((key, signature, whole, [dict(zip(names, c)) for c in chunks], dict(zip(fields, header)) if header else None, found))
        yield pd.DataFrame(rows, columns=["dataset_id", "signature_valid", "parsing_completed", "chunks", "ihdr", "issues"])


def analyse(files: DataFrame) -> DataFrame:
    """(dataset_id, data) -> a row per file: chunks, ihdr, issues, counts and validity flags. Null data is empty."""
    kind = dict(files.dtypes)["dataset_id"]
    d = files.select("dataset_id", "data").mapInPandas(_analyse, f"dataset_id {kind}, signature_valid boolean, parsing_completed boolean, chunks array<{CHUNK}>, ihdr {IHDR}, issues array<{ISSUE}>")
    valid = F.size(F.filter("chunks", lambda c: c["crc_valid"])).cast("bigint")
    d = d.withColumn("valid_crc_count", valid).withColumn("invalid_crc_count", F.size("chunks") - F.col("valid_crc_count"))
    d = d.withColumn("all_crcs_valid", (F.size("chunks") > 0) & (F.col("invalid_crc_count") == 0))
    d = d.withColumn("structurally_valid", F.col("parsing_completed") & ~F.exists("issues", lambda i: i["code_ord"] <= STRUCTURAL))
    return d.withColumn("semantically_valid", F.col("structurally_valid") & ~F.exists("issues", lambda i: i["code"].isin(*sorted(SEMANTIC))))


def chunk_rows(analysis: DataFrame) -> DataFrame:
    """A row per chunk."""
    return analysis.select("dataset_id", F.inline("chunks"))


def issue_rows(analysis: DataFrame) -> DataFrame:
    """A row per issue, seq its place in the order of finding."""
    return analysis.select("dataset_id", F.posexplode("issues").alias("seq", "x")).select("dataset_id", "seq", "x.*")


def _has(code: str) -> Column:
    return F.exists("issues", lambda i: i["code"] == code)


def _with(tag: str) -> Column:
    return F.exists("chunks", lambda c: c["type"] == tag)


def evidence(analysis: DataFrame) -> DataFrame:
    """(..., ranking_keys, facts): nine keys, larger is better, and nine named facts."""
    header = F.col("ihdr").isNotNull() & ~_has("invalid_ihdr_length") & ~_has("invalid_dimensions")
    one = lambda c: (F.col(c) if isinstance(c, str) else c).cast("bigint")
    word = lambda c: F.when(F.col(c) if isinstance(c, str) else c, "valid").otherwise("invalid")
    there = lambda t: F.when(_with(t), "present").otherwise("missing")
    size = F.size("chunks").cast("bigint")
    keys = F.array(one("structurally_valid"), one("all_crcs_valid"), -F.col("invalid_crc_count"), one("semantically_valid"), one("signature_valid"), one(header), one(_with("IDAT")), one(_with("IEND")), size)
    facts = {
        "PNG signature": word("signature_valid"),
        "PNG structure": word("structurally_valid"),
        "PNG semantics": word("semantically_valid"),
        "PNG IHDR": word(header),
        "PNG IDAT": there("IDAT"),
        "PNG IEND": there("IEND"),
        "PNG chunks": size.cast("string"),
        "CRC": F.concat(F.col("valid_crc_count").cast("string"), F.lit(" / "), size.cast("string"), F.lit(" valid")),
        "CRC failures": F.col("invalid_crc_count").cast("string"),
    }
    named = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in facts.items()])
    return analysis.withColumn("ranking_keys", keys).withColumn("facts", named)


def crc_repair(files: DataFrame, ambiguities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired files, a row per ambiguity).

    ambiguities: (dataset_id, position, votes array of (value, votes)). A row has position, chunk
    offset, before, after, candidates_tested, changed, reason and kind: repaired, corroborated or
    unresolved. Only an ambiguity alone in a chunk's type or data is tried, with its observed
    values only, and exactly one has to give the stored checksum.
    """
    chunks = chunk_rows(analyse(files)).select("dataset_id", F.col("offset").alias("c_at"), F.col("length").alias("c_len"), "stored_crc")
    a = ambiguities.select("dataset_id", "position", "votes")
    inside = (F.col("position") >= F.col("c_at") + 4) & (F.col("position") < F.col("c_at") + 8 + F.col("c_len"))
    # chunks don't overlap, so an ambiguity meets one at most
    placed = a.join(chunks, "dataset_id").where(inside)
    n = placed.groupBy("dataset_id", "c_at").agg(F.count("*").alias("n"))
    placed = placed.join(n, ["dataset_id", "c_at"])
    tried = placed.where("n = 1").join(files.select("dataset_id", "data"), "dataset_id")
    span = F.substr("data", (F.col("c_at") + 5).cast("int"), (F.col("c_len") + 4).cast("int"))
    tried = tried.withColumn("span", span).withColumn("before", byte_at("data", (F.col("position") + 1).cast("int"))).drop("data")
    at = (F.col("position") - F.col("c_at") - 4).cast("int")
    hits = F.transform(F.filter("votes", lambda v: F.crc32(splice("span", at, v["value"])) == F.col("stored_crc")), lambda v: v["value"])
    tried = tried.withColumn("hits", hits).select(
        "dataset_id", "position", "c_at", "before", F.when(F.size("hits") == 1, F.get("hits", 0)).alias("after"), F.size("votes").cast("bigint").alias("candidates_tested"), "stored_crc",
        F.when(F.size("hits") == 0, NO_MATCH).when(F.size("hits") > 1, MATCHES).alias("reason"),
    )
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    blank = [none("before", "smallint"), none("after", "smallint"), F.lit(0).cast("bigint").alias("candidates_tested"), none("stored_crc", "bigint")]
    several = placed.where("n > 1").select("dataset_id", "position", "c_at", *blank, F.lit(SEVERAL).alias("reason"))
    outside = a.join(placed.select("dataset_id", "position"), ["dataset_id", "position"], "left_anti").select("dataset_id", "position", none("c_at", "bigint"), *blank, F.lit(OUTSIDE).alias("reason"))
    rows = tried.unionByName(several).unionByName(outside)
    rows = rows.withColumn("changed", F.coalesce(F.col("after") != F.col("before"), F.lit(False)))
    rows = rows.withColumn("kind", F.when(F.col("after").isNull(), "unresolved").when(F.col("changed"), "repaired").otherwise("corroborated"))
    from fragweave.operators.repair import apply

    return apply(files, rows.where("changed").select("dataset_id", "position", "after")), rows


def crc_summary(files: DataFrame, repaired: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per file: eligible ambiguities, chunks evaluated, checksum counts before and after."""
    c = rows.groupBy("dataset_id").agg(
        F.count_if(F.col("c_at").isNotNull()).alias("eligible_ambiguous_bytes"),
        F.count_if(F.col("candidates_tested") > 0).alias("chunks_evaluated"),
        F.count_if(F.col("kind") == "unresolved").alias("unresolved"),
    )
    state = lambda d, k: analyse(d).select("dataset_id", F.col("valid_crc_count").alias(f"valid_{k}"), F.col("invalid_crc_count").alias(f"invalid_{k}"))
    return state(files, "before").join(state(repaired, "after"), "dataset_id").join(c, "dataset_id", "left").na.fill(0)


def report(consensus: DataFrame, crc_rows: DataFrame | None = None) -> DataFrame:
    """Repair report rows in order: dataset_id, seq, status, position, stage, baseline, result, evidence.

    consensus: positions() of consensus repair. With checksum rows, ambiguities appear as what became of them.
    """
    from pyspark.sql import Window

    from fragweave.operators.repair import vote_text

    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    row = lambda d, phase, status, stage, base, result, why: d.select("dataset_id", F.lit(phase).alias("phase"), status.alias("status"), "position", F.lit(stage).alias("stage"), base.alias("baseline"), result.alias("result"), why.alias("evidence"))
    dash = F.lit("-")
    out = row(consensus.where("kind = 'repaired'"), 0, F.lit("repaired"), "consensus", hex_byte("before"), hex_byte("after"), text(F.col("support").cast("string"), "/", F.col("observations").cast("string"), " votes"))
    if crc_rows is None:
        out = out.unionByName(row(consensus.where("kind = 'ambiguous'"), 1, F.lit("ambiguous"), "consensus", hex_byte("before"), dash, vote_text()))
    else:
        stored = text("CRC-consistent observed candidate; stored=", F.lower(F.lpad(F.hex("stored_crc"), 8, "0")))
        out = out.unionByName(row(crc_rows.where("kind <> 'unresolved'"), 1, F.col("kind"), "png_crc", hex_byte("before"), hex_byte("after"), stored))
        out = out.unionByName(row(crc_rows.where("kind = 'unresolved'"), 2, F.lit("unresolved"), "png_crc", dash, dash, F.col("reason")))
    seq = F.row_number().over(Window.partitionBy("dataset_id").orderBy("phase", "position"))
    return out.withColumn("seq", seq.cast("bigint")).drop("phase")


def candidate_evidence(candidates: DataFrame) -> DataFrame:
    """The png evaluator of search: (dataset_id, rank, data) -> with ranking_keys and facts."""
    keyed = candidates.select(F.struct("dataset_id", "rank").alias("dataset_id"), "data")
    d = keyed.withColumn("dataset_id", F.to_json("dataset_id", {"ignoreNullFields": "false"}))
    kind = candidates.schema["dataset_id"].dataType.simpleString()
    e = evidence(analyse(d)).withColumn("k", F.from_json("dataset_id", f"dataset_id {kind}, rank bigint"))
    return e.select("k.dataset_id", "k.rank", "ranking_keys", "facts")


search.EVALUATORS["png"] = candidate_evidence
