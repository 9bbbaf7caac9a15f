"""Synthetic inputs: seeded payloads, datasets with an exact number of fragments, small PNG files."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.operators.damage import digest
from fragweave.operators.png import SIGNATURE
from fragweave.operators.shard import shard


def payloads(spark: SparkSession, sizes: dict[int, int], seed: int = 0) -> DataFrame:
    """(dataset_id, data): pseudo-random bytes of the given sizes, from MD5 blocks of seed, dataset and block number."""
    d = spark.createDataFrame(sorted(sizes.items()), "dataset_id long, n int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 16).cast("int")), lambda b: digest(seed, "source", "dataset_id", b))
    data = F.when(F.col("n") > 0, F.substr(F.unhex(F.array_join(blocks, "")), F.lit(1), F.col("n"))).otherwise(F.lit(b""))
    return d.select("dataset_id", data.alias("data"))


def dataset(spark: SparkSession, fragments: int, size: int, overlap: int, seed: int = 0, datasets: int = 1) -> DataFrame:
    """Shards of payloads that give exactly `fragments` full fragments in each dataset."""
    if fragments < 1:
        raise ValueError("at least one fragment")
    n = size + (fragments - 1) * (size - overlap)
    return shard(payloads(spark, {k: n for k in range(datasets)}, seed), size, overlap)


def png_chunk(tag: bytes, body: bytes = b"", flip: bool = False) -> bytes:
    """A chunk; flip spoils its checksum."""
    crc = zlib.crc32(tag + body) ^ (1 if flip else 0)
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", crc)


def png_header(width: int = 1, height: int = 1, depth: int = 8, colour: int = 6, compression: int = 0, filters: int = 0, interlace: int = 0) -> bytes:
    """The body of a header chunk."""
    return struct.pack(">IIBBBBB", width, height, depth, colour, compression, filters, interlace)


def png_seeds() -> dict[str, bytes]:
    """Valid and faulty small files by name, a fault each."""
    head, data, end = png_chunk(b"IHDR", png_header()), png_chunk(b"IDAT"), png_chunk(b"IEND")
    whole = SIGNATURE + head + data + end
    return {
        "valid": whole,
        "empty": b"",
        "short_signature": SIGNATURE[:5],
        "bad_signature": b"\0" + whole[1:],
        "truncated_header": SIGNATURE + b"\0",
        "truncated_chunk": SIGNATURE + struct.pack(">I", 20) + b"IHDR" + png_header(),
        "huge_length": SIGNATURE + b"\xff\xff\xff\xff" + b"IHDR" + b"\0" * 8,
        "idat_first": SIGNATURE + data + head + end,
        "duplicate_ihdr": SIGNATURE + head + head + data + end,
        "short_ihdr": SIGNATURE + png_chunk(b"IHDR", png_header()[:12]) + data + end,
        "zero_width": SIGNATURE + png_chunk(b"IHDR", png_header(0)) + data + end,
        "no_idat": SIGNATURE + head + end,
        "no_iend": SIGNATURE + head + data,
        "iend_with_data": SIGNATURE + head + data + png_chunk(b"IEND", b"x"),
        "trailing": whole + b"x",
        "crc": SIGNATURE + head + png_chunk(b"IDAT", b"", True) + end,
        "split_idat": SIGNATURE + head + data + png_chunk(b"tEXt", b"a") + data + end,
        "interlace": SIGNATURE + png_chunk(b"IHDR", png_header(interlace=2)) + data + end,
        "depth": SIGNATURE + png_chunk(b"IHDR", png_header(depth=4)) + data + end,
        "methods": SIGNATURE + png_chunk(b"IHDR", png_header(compression=1, filters=1)) + data + end,
        "chunk_type": SIGNATURE + head + data + png_chunk(b"ID1T") + end,
    }


def overlap_seeds() -> dict[str, bytes]:
    """Inputs of overlap checks by name: three bytes that overlap_case() reads, then the bytes that are split in two."""
    # Seeds that overlap checks start from.
    return {
        "exact-overlap": bytes([128, 1, 0]) + b"ABCBCD",
        "no-overlap": bytes([128, 0, 0]) + b"ABCXYZ",
        "one-mismatch": bytes([128, 1, 1]) + b"ABCDCxEF",
        "multiple-mismatches": bytes([128, 1, 2]) + b"ABCDxyEF",
        "empty-left": bytes([0, 0, 0]) + b"payload",
        "empty-right": bytes([255, 0, 0]) + b"payload",
        "binary-bytes": bytes([128, 0, 1]) + b"\x00\xff\x80\x13\x80\x13\x7a\x00",
        "directional": bytes([128, 1, 0]) + b"ABCDEFCDEFZZ",
        "minimum-boundary": bytes([128, 255, 0]) + b"AAAAAA",
    }


def overlap_case(seed: bytes) -> tuple[bytes, bytes, int, int] | None:
    """(left, right, least overlap, most mismatches) of a seed; None without its three bytes.

    The first byte is the share of the payload that goes left, in 256ths; the others, modulo the
    number of possible overlaps, are the least overlap less one and the mismatches.
    """
    if len(seed) < 3:
        return None
    share, least, misses = seed[:3]
    payload = seed[3:]
    cut = share * (len(payload) + 1) // 256
    left, right = payload[:cut], payload[cut:]
    most = min(len(left), len(right))
    return (left, right, 1 + least % (most + 1), misses % (most + 1)) if most else (left, right, 1, 0)
