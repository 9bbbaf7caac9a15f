"""Small tables for the tests."""

from pyspark.sql import functions as F


def fragments(spark, rows, names=None, ds=1):
    """Nodes in list order from byte strings or texts."""
    data = [(ds, i, r if isinstance(r, bytes) else r.encode(), names[i] if names else f"f{i:04d}") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "dataset_id long, node_id long, data binary, filename string")


def edge_set(edges):
    return {(r.src, r.dst): (r.overlap, r.matches, r.mismatches, r.exact, tuple(map(tuple, r.mismatch_details))) for r in edges.collect()}


def brute_edge(left: bytes, right: bytes, least: int, k: int):
    """(overlap, mismatch offsets) by trying all lengths, or None."""
    most = min(len(left), len(right))
    for n in range(most, least - 1, -1):
        if left[len(left) - n :] == right[:n]:
            return n, ()
    for n in range(most, least - 1, -1):
        bad = [i for i in range(n) if left[len(left) - n + i] != right[i]]
        if len(bad) <= k:
            return n, tuple(bad)
    return None


def steps_with(spark, overlaps, ds=1):
    rows = [(ds, i, i, o, o, 0, True) for i, o in enumerate(overlaps)]
    return spark.createDataFrame(rows, "dataset_id long, step_no long, node_id long, overlap_from_previous long, matches long, mismatches long, exact boolean")


def collect(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def sort_by(df, *columns):
    return df.orderBy(*[F.col(c) for c in columns]).collect()
