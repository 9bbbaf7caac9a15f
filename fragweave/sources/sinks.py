"""Sinks: fragment and output files, repair reports, traces, benchmark rows, summaries.

Files are written by the tasks that hold them, through Hadoop's own output committers where
Spark has a writer (text, CSV, JSON), and one file for each row where the reference's users
expect a plain binary file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, folder: str, name: str = "filename", data: str = "data") -> int:
    """One binary file per row in a folder that tasks can write to (a mounted or local one); returns their number.

    Each is written under a name of its own and then renamed, so a task that runs again leaves
    whole files only. On a cluster prefer a Parquet table with a BINARY column.
    """
    os.makedirs(folder, exist_ok=True)

    def put(batches):
        import uuid

        for pdf in batches:
            for n, d in zip(pdf[name], pdf[data]):
                part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
                with open(part, "wb") as f:
                    f.write(bytes(d))
                os.replace(part, os.path.join(folder, os.path.basename(n)))
            yield pdf[[name]]

    return rows.select(name, data).mapInPandas(put, f"{name} string").count()


def write_report(report: DataFrame, path: str) -> None:
    """A repair report as tab-separated text with a header, a folder per dataset, rows in order."""
    d = report.repartition("dataset_id").sortWithinPartitions("dataset_id", "seq")
    d.select("dataset_id", "status", "position", "stage", "baseline", "result", "evidence").write.partitionBy("dataset_id").mode("overwrite").csv(path, sep="\t", header=True, quote="")


def write_traces(json: DataFrame, path: str) -> None:
    """Traces as one JSON line per dataset, a folder per dataset."""
    json.select("dataset_id", F.col("json").alias("value")).write.partitionBy("dataset_id").mode("overwrite").text(path)


def write_benchmark(metrics: DataFrame, path: str) -> None:
    """Metrics as CSV with a header."""
    metrics.write.mode("overwrite").csv(path, header=True)


def summary(row: dict) -> str:
    """`name: value` lines."""
    shown = lambda v: "yes" if v is True else "no" if v is False else "-" if v is None else str(v)
    return "\n".join(f"{k.replace('_', ' ')}: {shown(v)}" for k, v in row.items())
