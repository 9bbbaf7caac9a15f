"""Fragments from folders of files: scan, load order, preview."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragweave.functions.bytes import preview

#: Accepted for parity of options; Spark owns the reading either way.
IO = ("buffered", "mmap")
#: Names that Spark's file source leaves out or reads as a pattern; tasks open such files themselves, and empty ones, which it leaves out too.
_ODD = re.compile(r"^[._]|\._COPYING_$|[\[\]{}*?\\,]")


def _open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, name) to (name, length, content), a file at a time."""
    from pyarrow import fs

    for pdf in batches:
        for path, name in zip(pdf["path"], pdf["name"]):
            if re.match(r"^(file:)?/", path):
                with open(re.sub(r"^file:/*", "/", path), "rb") as f:
                    data = f.read()
            else:
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner) as f:
                    data = f.read()
            yield pd.DataFrame({"name": [name], "length": [len(data)], "content": [data]})


def _read(spark: SparkSession, files: list[tuple[str, str, int]]) -> DataFrame:
    """(path, name, size) of listed files -> (name, length, content), read by tasks."""
    raw = spark.createDataFrame([], "name string, length long, content binary")
    plain = [p for p, n, size in files if size and not _ODD.search(n)]
    if plain:
        # the files themselves and not the folder: nothing below it is listed or taken for a partition
        read = spark.read.format("binaryFile").load(plain)
        raw = raw.unionByName(read.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", "content"))
    odd = [(p, n) for p, n, size in files if not size or _ODD.search(n)]
    if odd:
        listed = spark.createDataFrame(odd, "path string, name string").repartition(min(len(odd), 1000))
        raw = raw.unionByName(listed.mapInPandas(_open, "name string, length long, content binary"))
    return raw


def load_file(spark: SparkSession, path: str, dataset_id: int = 0) -> DataFrame:
    """(dataset_id, filename, data) of one regular file, whatever its name; one that isn't there is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isFile():
        raise ValueError(f"no file: {path}")
    f = fs.getFileStatus(where)
    raw = _read(spark, [(f.getPath().toString(), f.getPath().getName(), f.getLen())])
    return raw.select(F.lit(dataset_id).cast("long").alias("dataset_id"), F.col("name").alias("filename"), F.col("content").alias("data"))


def load_directory(spark: SparkSession, path: str, dataset_id: int = 0, io: str = "buffered") -> DataFrame:
    """(dataset_id, node_id, filename, size, data) of all regular files of a folder, whatever their names, not of folders below.

    The files are listed here and read by tasks. Ids follow the file names in byte order. An empty folder gives no rows; one that isn't there,
    or a file, is an error. The window runs over one folder, whose names alone are sorted.
    """
    if io not in IO:
        raise ValueError(f"io has to be one of {', '.join(IO)}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise ValueError(f"no folder: {path}")
    raw = _read(spark, [(f.getPath().toString(), f.getPath().getName(), f.getLen()) for f in fs.listStatus(where) if f.isFile()])
    named = raw.select(F.lit(dataset_id).cast("long").alias("dataset_id"), F.col("name").alias("filename"), F.col("length").alias("size"), F.col("content").alias("data"))
    return with_node_ids(named)


def load_directories(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Several folders as datasets, by dataset id."""
    out = None
    for k, p in sorted(paths.items()):
        one = load_directory(spark, p, k)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no folders")
    return out


def with_node_ids(frags: DataFrame, together: bool = False) -> DataFrame:
    """(dataset_id, filename, data, ...) with node_id, the 0-based place by file name in byte order within its dataset.

    Only names are sorted; the payload joins its id again by name. With `together`, where a
    dataset's payload lies in one partition anyway, it is sorted along and moves no more.
    """
    w = Window.partitionBy("dataset_id").orderBy("filename")
    node_id = (F.row_number().over(w) - 1).cast("bigint")
    if together:
        return frags.withColumn("node_id", node_id)
    ids = frags.select("dataset_id", "filename").withColumn("node_id", node_id)
    return frags.join(ids, ["dataset_id", "filename"])


def inspect(files: DataFrame, name: str = "filename", data: str = "data") -> DataFrame:
    """(name, size, preview): size and first 16 bytes in hex."""
    return files.select(name, F.length(data).cast("bigint").alias("size"), preview(data).alias("preview"))
