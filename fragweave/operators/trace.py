"""The reconstruction trace: one nested document per dataset, its JSON, its checks, and the viewer's queries over it."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragweave.functions.bytes import format_byte, format_offset
from fragweave.operators import graph
from fragweave.operators.overlap import _portions

VERSION = 1
ENGINE = ("fragweave", "0.1")
_DETAIL = "overlap_offset:bigint,left_byte:smallint,right_byte:smallint"
_EDGE = f"`from`:bigint,`to`:bigint,overlap:bigint,matches:bigint,mismatches:bigint,exact:boolean,mismatch_details:array<struct<{_DETAIL}>>"
_REPAIR = "position:bigint,stage:string,before:smallint,after:smallint,support:bigint,observations:bigint,candidates_tested:bigint,crc_consistent:boolean"
_FORMAT = (
    "type:string,signature_valid:boolean,structurally_valid:boolean,width:bigint,height:bigint,valid_crc_count:bigint,invalid_crc_count:bigint,all_crc_valid:boolean,"
    "chunks:array<struct<index:bigint,offset:bigint,type:string,length:bigint,crc_valid:boolean>>"
)
SCHEMA = (
    "struct<schema_version:int,engine:struct<name:string,version:string>,"
    "configuration:struct<min_overlap:bigint,max_mismatches:bigint,graph_build:string,threads:bigint,strategy:string,beam_width:bigint,io:string,format:string,repair:string>,"
    "fragments:array<struct<id:bigint,name:string,size:bigint>>,"
    f"edges:array<struct<{_EDGE}>>,selected_path:array<bigint>,"
    "reconstruction:struct<strategy:string,complete:boolean,fragments_used:bigint,fragments_total:bigint,output_bytes:bigint,approximate_joins:bigint,overlap_mismatches:bigint>,"
    f"mismatches:array<struct<`from`:bigint,`to`:bigint,{_DETAIL}>>,repairs:array<struct<{_REPAIR}>>,unresolved_ambiguities:bigint,format:struct<{_FORMAT}>,"
    "graph_stats:struct<strategy:string,theoretical_pairs:bigint,candidate_pairs:bigint,full_overlap_checks:bigint,edges_created:bigint,threads_used:bigint>>"
)


@dataclass(frozen=True)
class TraceConfig:
    """What the trace says about how it came to be."""

    min_overlap: int = 1
    max_mismatches: int = 0
    graph_build: str = "exhaustive"
    threads: int = 1
    strategy: str = "greedy"
    beam_width: int = 1
    io: str = "buffered"
    format: str = "none"
    repair: str = "none"


def _list(d: DataFrame, name: str, item: Column, order: list[str]) -> DataFrame:
    """(dataset_id, name): the items of each dataset in order."""
    keyed = F.collect_list(F.struct(F.struct(*order).alias("k"), item.alias("x")))
    return d.groupBy("dataset_id").agg(F.transform(F.sort_array(keyed), lambda r: r["x"]).alias(name))


def build(nodes: DataFrame, edges: DataFrame, steps: DataFrame, totals: DataFrame, stats: DataFrame, config: TraceConfig, consensus: DataFrame | None = None, crc_rows: DataFrame | None = None, analysis: DataFrame | None = None) -> DataFrame:
    """(dataset_id, trace). edges with rank, in edge order; consensus: positions; crc_rows, analysis: of PNG repair.

    Names are file names only, and nothing of the truth is in it. A trace is a document for one
    viewer: it holds a dataset's graph, as the file it becomes does.
    """
    frag = _list(nodes, "fragments", F.struct(F.col("node_id").alias("id"), F.col("filename").alias("name"), F.length("data").cast("bigint").alias("size")), ["node_id"])
    edge = _list(edges, "edges", F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "overlap", "matches", "mismatches", "exact", "mismatch_details"), ["rank"])
    path = _list(steps, "selected_path", F.col("node_id"), ["step_no"])
    w = Window.partitionBy("dataset_id").orderBy("step_no")
    pairs = steps.withColumn("src", F.lag("node_id").over(w)).where("src is not null").select("dataset_id", "step_no", "src", F.col("node_id").alias("dst"))
    miss = pairs.join(edges.select("dataset_id", "src", "dst", "mismatch_details"), ["dataset_id", "src", "dst"]).select("dataset_id", "step_no", "src", "dst", F.posexplode("mismatch_details").alias("i", "m"))
    miss = _list(miss, "mismatch_list", F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("m.overlap_offset"), F.col("m.left_byte"), F.col("m.right_byte")), ["step_no", "i"])
    d = nodes.select("dataset_id").distinct()
    sums = totals.withColumnsRenamed({"mismatches": "path_mismatches", "overlap": "path_overlap"})
    for part in (frag, edge, path, miss, sums, stats.withColumnRenamed("edges", "edges_created")):
        d = d.join(part, "dataset_id", "left")
    none = F.array().cast(f"array<struct<{_REPAIR}>>")
    d = d.withColumn("unresolved", F.lit(0).cast("bigint")).withColumn("consensus_repairs", none).withColumn("crc_repairs", none)
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    if consensus is not None:
        r = consensus.where("kind = 'repaired'")
        r = _list(r, "_r", F.struct("position", F.lit("consensus").alias("stage"), "before", "after", "support", "observations", zero.alias("candidates_tested"), no.alias("crc_consistent")), ["position"])
        n = consensus.groupBy("dataset_id").agg(F.count_if(F.col("kind") == "ambiguous").alias("_n"))
        d = d.join(r, "dataset_id", "left").join(n, "dataset_id", "left").withColumn("consensus_repairs", F.coalesce("_r", none)).withColumn("unresolved", F.coalesce("_n", zero)).drop("_r", "_n")
    if crc_rows is not None:
        r = crc_rows.where("kind <> 'unresolved'")
        r = _list(r, "_r", F.struct("position", F.lit("png_crc").alias("stage"), "before", "after", zero.alias("support"), zero.alias("observations"), "candidates_tested", F.lit(True).alias("crc_consistent")), ["position"])
        n = crc_rows.groupBy("dataset_id").agg(F.count_if(F.col("kind") == "unresolved").alias("_n"))
        d = d.join(r, "dataset_id", "left").join(n, "dataset_id", "left").withColumn("crc_repairs", F.coalesce("_r", none)).withColumn("unresolved", F.coalesce("_n", zero)).drop("_r", "_n")
    if analysis is not None:
        chunks = F.transform("chunks", lambda c: F.struct(c["idx"].cast("bigint").alias("index"), c["offset"].alias("offset"), c["type"].alias("type"), c["length"].alias("length"), c["crc_valid"].alias("crc_valid")))
        form = F.struct(F.lit("png").alias("type"), "signature_valid", "structurally_valid", F.col("ihdr.width").alias("width"), F.col("ihdr.height").alias("height"), "valid_crc_count", "invalid_crc_count", F.col("all_crcs_valid").alias("all_crc_valid"), chunks.alias("chunks"))
        d = d.join(analysis.select("dataset_id", form.alias("format")), "dataset_id", "left")
    else:
        nothing = F.array().cast("array<struct<index:bigint,offset:bigint,type:string,length:bigint,crc_valid:boolean>>")
        null = F.lit(None).cast("bigint")
        d = d.withColumn("format", F.struct(F.lit("none").alias("type"), no.alias("signature_valid"), no.alias("structurally_valid"), null.alias("width"), null.alias("height"), zero.alias("valid_crc_count"), zero.alias("invalid_crc_count"), no.alias("all_crc_valid"), nothing.alias("chunks")))
    return _document(d, config)


def of_lists(lists: DataFrame, config: TraceConfig, stats: graph.GraphConfig) -> DataFrame:
    """build() of within.recover()'s fragments, edges, steps and disputed: datasets are rows already, so nothing moves."""
    count = lambda c: F.size(c).cast("bigint")
    total = lambda f: F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, s: n + f(s))
    d = lists.withColumnRenamed("edges", "edge_list").withColumns({"nodes": count("fragments"), "edges": count("edge_list"), "exact_edges": count(F.filter("edge_list", lambda e: e["exact"]))})
    d = graph.counted(d, stats, "fragments", "edge_list", "steps", "disputed")
    of_join = lambda s, i: F.transform(F.coalesce(s["mismatch_details"], F.array().cast(f"array<struct<{_DETAIL}>>")), lambda m: F.struct(F.get("steps", i - 1)["node_id"].alias("from"), s["node_id"].alias("to"), m["overlap_offset"], m["left_byte"], m["right_byte"]))
    fixed = F.array_sort(F.filter("disputed", lambda p: p["kind"] == "repaired"))
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    d = d.withColumnRenamed("edges", "edges_created").withColumns(
        {
            "edges": F.col("edge_list").cast(f"array<struct<{_EDGE}>>"),
            "selected_path": F.transform("steps", lambda s: s["node_id"]),
            "n_steps": count("steps"),
            "complete": count("steps") == F.col("nodes"),
            "recovered_size": total(lambda s: s["size"] - s["overlap_from_previous"]),
            "approximate_joins": total(lambda s: (~s["exact"]).cast("bigint")),
            "path_mismatches": total(lambda s: s["mismatches"]),
            "mismatch_list": F.flatten(F.transform("steps", of_join)).cast(f"array<struct<`from`:bigint,`to`:bigint,{_DETAIL}>>"),
            "consensus_repairs": F.transform(fixed, lambda p: F.struct(p["position"], F.lit("consensus"), p["before"], p["after"], p["support"], p["observations"], zero, no)).cast(f"array<struct<{_REPAIR}>>"),
            "crc_repairs": F.array().cast(f"array<struct<{_REPAIR}>>"),
            "unresolved": count(F.filter("disputed", lambda p: p["kind"] == "ambiguous")),
            "format": F.struct(F.lit("none"), no, no, F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), zero, zero, no, F.array()).cast(f"struct<{_FORMAT}>"),
        }
    )
    return _document(d, config)


def _document(d: DataFrame, config: TraceConfig) -> DataFrame:
    """(dataset_id, trace) of a row per dataset with all of a trace's parts."""
    c, zero = config, F.lit(0).cast("bigint")
    big = lambda v: F.lit(v).cast("bigint")
    empty = lambda col, kind: F.coalesce(col, F.array().cast(kind))
    trace = F.struct(
        F.lit(VERSION).alias("schema_version"),
        F.struct(F.lit(ENGINE[0]).alias("name"), F.lit(ENGINE[1]).alias("version")).alias("engine"),
        F.struct(big(c.min_overlap).alias("min_overlap"), big(c.max_mismatches).alias("max_mismatches"), F.lit(c.graph_build).alias("graph_build"), big(c.threads).alias("threads"), F.lit(c.strategy).alias("strategy"), big(c.beam_width).alias("beam_width"), F.lit(c.io).alias("io"), F.lit(c.format).alias("format"), F.lit(c.repair).alias("repair")).alias("configuration"),
        F.col("fragments"),
        empty("edges", f"array<struct<{_EDGE}>>").alias("edges"),
        F.col("selected_path"),
        F.struct(F.lit(c.strategy).alias("strategy"), "complete", F.col("n_steps").alias("fragments_used"), F.col("nodes").alias("fragments_total"), F.col("recovered_size").alias("output_bytes"), "approximate_joins", F.col("path_mismatches").alias("overlap_mismatches")).alias("reconstruction"),
        empty("mismatch_list", f"array<struct<`from`:bigint,`to`:bigint,{_DETAIL}>>").alias("mismatches"),
        F.concat("consensus_repairs", "crc_repairs").alias("repairs"),
        F.col("unresolved").alias("unresolved_ambiguities"),
        F.col("format"),
        F.struct(F.col("effective_strategy").alias("strategy"), "theoretical_pairs", "candidate_pairs", F.col("full_checks").alias("full_overlap_checks"), F.col("edges_created").alias("edges_created"), "threads_used").alias("graph_stats"),
    )
    return d.select("dataset_id", trace.cast(SCHEMA).alias("trace"))


def to_json(traces: DataFrame) -> DataFrame:
    """(dataset_id, json); absent width and height are written as null."""
    return traces.select("dataset_id", F.to_json("trace", {"ignoreNullFields": "false"}).alias("json"))


def parse(texts: DataFrame) -> DataFrame:
    """(dataset_id, json) -> (dataset_id, trace, error). error: what the checks found first, else null.

    Malformed JSON, another version, missing arrays or summaries, untyped fragments, and path or
    edge ends that aren't fragments are errors; trace is null with one.
    """
    arrays, objects = ("fragments", "edges", "selected_path"), ("reconstruction", "configuration", "graph_stats", "format")
    top = {k: f"_{k}" for k in ("schema_version", *arrays, *objects)}
    d = texts.select("dataset_id", "json", F.json_tuple("json", *top).alias(*top.values())).withColumn("t", F.from_json("json", SCHEMA))
    version = F.col("_schema_version")
    is_object = F.coalesce(F.trim("json").startswith("{") & F.json_object_keys("json").isNotNull(), F.lit(False))
    array = lambda k: F.coalesce(F.col(top[k]).startswith("["), F.lit(False))
    has = lambda k: F.coalesce(F.col(top[k]).startswith("{"), F.lit(False))
    ids = F.transform("t.fragments", lambda f: f["id"])
    typed = F.forall("t.fragments", lambda f: f["id"].isNotNull() & f["name"].isNotNull() & f["size"].isNotNull())
    known = lambda x: F.size(F.array_except(x, ids)) == 0
    error = (
        F.when(~is_object, "not a JSON object")
        .when(~F.coalesce(version == str(VERSION), F.lit(False)), F.concat(F.lit("unsupported schema version: "), F.coalesce(version, F.lit("none"))))
        .when(~(array("fragments") & array("edges") & array("selected_path")), "fragments, edges and selected_path have to be arrays")
        .when(~(has("reconstruction") & has("configuration") & has("graph_stats") & has("format")), "a summary object is missing")
        .when(~F.coalesce(typed, F.lit(False)), "invalid fragment metadata")
        .when(~F.coalesce(known(F.col("t.selected_path")), F.lit(False)), "the path has an unknown fragment")
        .when(~F.coalesce(known(F.col("t.edges.from")) & known(F.col("t.edges.to")), F.lit(False)), "an edge has an unknown fragment")
    )
    return d.withColumn("error", error).select("dataset_id", F.when(F.col("error").isNull(), F.col("t")).alias("trace"), "error")


def load(spark, path: str) -> DataFrame:
    """Traces from whole JSON files, checked: (dataset_id: the file's path, trace, error)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("dataset_id"), F.col("value").alias("json"))
    return parse(raw)


# The viewer's queries. Each takes (dataset_id, trace).


def edge_rows(traces: DataFrame) -> DataFrame:
    """Edges with index, their place in the trace."""
    return traces.select("dataset_id", F.posexplode("trace.edges").alias("index", "e")).select("dataset_id", F.col("index").cast("bigint"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.overlap", "e.matches", "e.mismatches", "e.exact", "e.mismatch_details")


def selected_pairs(traces: DataFrame) -> DataFrame:
    """(dataset_id, place, src, dst, pair) of neighbours on the path."""
    d = traces.select("dataset_id", F.col("trace.selected_path").alias("p")).select("dataset_id", "p", F.posexplode("p").alias("place", "dst"))
    d = d.withColumn("src", F.get("p", F.col("place") - 1)).where("src is not null")
    return d.select("dataset_id", (F.col("place") - 1).cast("bigint").alias("place"), "src", "dst", F.concat_ws("->", "src", "dst").alias("pair"))


def filter_edges(traces: DataFrame, exact: bool = True, approximate: bool = True, path: bool = True) -> DataFrame:
    """Edges of the kinds asked for; path=False leaves out those of the path."""
    kind = F.when(F.col("exact"), exact).otherwise(approximate)
    return edge_rows(traces).where(kind) if path else join_indices(traces).where(kind & (F.col("join_index") < 0)).drop("join_index")


def edge_label() -> Column:
    """"N B" or "N B · k mismatches"."""
    n = F.concat(F.col("overlap").cast("string"), F.lit(" B"))
    return F.when(F.col("exact"), n).otherwise(F.concat(n, F.lit(" · "), F.col("mismatches").cast("string"), F.when(F.col("mismatches") == 1, " mismatch").otherwise(" mismatches")))


#: Items of lists that a row function holds as Python objects at once.
ITEMS = 200_000


def _row_wise(f, kind: str, *columns: Column) -> Column:
    """f of each row's lists, as a column of a select(). A trace is one row, so what its lists have in common is found there and nothing moves."""
    longs = pa.list_(pa.int64())
    arrow = longs if kind == "array<bigint>" else pa.list_(longs)

    def run(*lists: pa.Array) -> pa.Array:
        items = sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
        out = [pa.array([], arrow)]
        for z in _portions(items, ITEMS):  # Python's own numbers and lists take many times a batch's bytes
            own = [c.slice(z.start, z.stop - z.start).to_pylist() for c in lists]
            out.append(pa.array([f(*(x or [] for x in row)) for row in zip(*own)], arrow))
        return pa.concat_arrays(out)

    # else the optimizer infers filters from generators above and evaluates it there
    return F.arrow_udf(run, kind).asNondeterministic()(*columns)


def _pairs(src: list, dst: list, path: list) -> list:
    """Places of the first edges of the path's joins; joins without one are left out."""
    first: dict = {}
    for i, e in enumerate(zip(src, dst)):
        first.setdefault(e, i)
    return [first[e] for e in zip(path, path[1:]) if e in first]


def _on_path(src: list, dst: list, path: list) -> list:
    """Of each edge the place of its first join among those with an edge, or -1."""
    edges = set(zip(src, dst))
    on: dict = {}
    for k, e in enumerate(e for e in zip(path, path[1:]) if e in edges):
        on.setdefault(e, k)
    return [on.get(e, -1) for e in zip(src, dst)]


def _nearest(target: list) -> list:
    """Of each place the nearest places before and after it that are targets."""
    before, after, last = [], [], None
    for k, x in enumerate(target):
        before.append(last)
        last = k if x else last
    last = None
    for k in range(len(target) - 1, -1, -1):
        after.append(last)
        last = k if target[k] else last
    return [list(x) for x in zip(before, after[::-1])]


def _spots(ids: list, path: list) -> list:
    """Of each fragment its 1-based place on the path, or 0 and its place among those off it."""
    at: dict = {}
    for k, v in enumerate(path):
        at.setdefault(v, k + 1)
    off, out = 0, []
    for v in ids:
        out.append([at.get(v, 0), off])
        off += v not in at
    return out


def _ways(ids: list, src: list, dst: list, path: list) -> list:
    """Of each fragment its incoming and outgoing edges and its place on the path, or -1."""
    into, out = Counter(dst), Counter(src)
    return [[into[v], out[v], at - 1] for v, (at, _) in zip(ids, _spots(ids, path))]


def _joined(traces: DataFrame, **others: Column) -> DataFrame:
    """(dataset_id, joins, others): the edge of each join of the path in order, as structs with index and join_index."""
    d = traces.select("dataset_id", F.col("trace.edges").alias("e"), F.col("trace.selected_path").alias("p"), *[c.alias(k) for k, c in others.items()])
    d = d.select("dataset_id", "e", _row_wise(_pairs, "array<bigint>", F.col("e.from"), F.col("e.to"), F.col("p")).alias("at"), *others)

    def join(i, k):
        e = F.get("e", i.cast("int"))
        return F.struct(e["from"].alias("src"), e["to"].alias("dst"), i.alias("index"), *[e[c].alias(c) for c in ("overlap", "matches", "mismatches", "exact", "mismatch_details")], k.cast("bigint").alias("join_index"))

    return d.select("dataset_id", F.transform("at", join).alias("joins"), *others)


def path_edges(traces: DataFrame) -> DataFrame:
    """The edge of each join of the path (joins without one are left out), join_index counting those found."""
    return _joined(traces).select("dataset_id", F.inline("joins"))


def join_indices(traces: DataFrame) -> DataFrame:
    """Every edge with its place among the path's joins, -1 off the path."""
    d = traces.select("dataset_id", F.col("trace.edges").alias("e"), F.col("trace.selected_path").alias("p"))
    d = d.select("dataset_id", "e", _row_wise(_on_path, "array<bigint>", F.col("e.from"), F.col("e.to"), F.col("p")).alias("at"))
    edge = lambda e, i: F.struct(e["from"].alias("src"), e["to"].alias("dst"), i.cast("bigint").alias("index"), *[e[c].alias(c) for c in ("overlap", "matches", "mismatches", "exact", "mismatch_details")], F.get("at", i).alias("join_index"))
    return d.select("dataset_id", F.inline(F.transform("e", edge)))


def adjacent_joins(traces: DataFrame, mismatches_only: bool = False) -> DataFrame:
    """Each join of the path with the index of the one before and after it; with mismatches_only, of the nearest that have mismatches."""
    target = F.transform("joins", lambda j: (j["mismatches"] > 0) if mismatches_only else F.lit(True))
    d = _joined(traces).select("dataset_id", "joins", target.alias("t"))
    d = d.select("dataset_id", "joins", _row_wise(_nearest, "array<array<bigint>>", F.col("t")).alias("near"))
    both = F.transform("joins", lambda j, k: F.struct(j.alias("j"), *[F.get(F.get("near", k), F.lit(i)).alias(c) for i, c in enumerate(("previous", "next"))]))
    return d.select("dataset_id", F.inline(both)).select("dataset_id", "j.*", "previous", "next")


def layout(traces: DataFrame) -> DataFrame:
    """(dataset_id, node_id, x, y): the path in a row, other fragments in three columns below in order of the list."""
    d = traces.select("dataset_id", F.col("trace.fragments.id").alias("ids"), F.col("trace.selected_path").alias("p"))
    d = d.select("dataset_id", "ids", _row_wise(_spots, "array<array<bigint>>", F.col("ids"), F.col("p")).alias("spot")).select("dataset_id", F.explode(F.arrays_zip("ids", "spot")).alias("f"))
    d = d.select("dataset_id", F.col("f.ids").alias("node_id"), F.get("f.spot", F.lit(0)).alias("at"), F.get("f.spot", F.lit(1)).alias("k"))
    off = F.col("at") == 0
    x = F.when(off, 120 + (F.col("k") % 3) * 220).otherwise(80 + (F.col("at") - 1) * 230)
    y = F.when(off, 210 + F.floor(F.col("k") / 3) * 130).otherwise(70)
    return d.select("dataset_id", "node_id", x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))


def _told(kind: str, c) -> tuple[Column, Column]:
    """(label, detail) of an event; c: its column of a name."""
    s = lambda x: (c(x) if isinstance(x, str) else x).cast("string")
    t = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    if kind == "graph":
        return F.lit("Graph built"), t(s("fragments"), " fragments · ", s("edges"), " edges")
    if kind == "path":
        return F.lit("Path selected"), t(s("steps"), " fragments · ", F.when(c("complete"), "Complete").otherwise("Incomplete"))
    if kind == "join":
        number = s(c("join_index") + 1)
        padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
        return t("JOIN ", padded, " · F", s("src"), " → F", s("dst")), t(s("overlap"), " B · ", F.when(c("exact"), "Exact").otherwise(t("Approximate · ", s("mismatches"), " mismatches")))
    if kind == "repair":
        return t(F.when(c("stage") == "png_crc", "PNG CRC").otherwise("Consensus"), " repair"), t("Offset ", format_offset(c("position"), 1), " · ", s("before"), " → ", s("after"))
    return t(F.upper(c("type")), " analysis"), t(s("valid"), " valid CRC · ", s("invalid"), " invalid")


def _events(graph: DataFrame, path: DataFrame, joins: DataFrame, fixes: DataFrame, form: DataFrame | None) -> DataFrame:
    """(dataset_id, seq, kind, label, detail, edge_index, repair_index): graph, path, joins, repairs, format, in order.

    graph: (dataset_id, fragments, edges); path: (dataset_id, steps, complete); joins: path_edges();
    fixes: (dataset_id, i, stage, position, before, after); form: (dataset_id, type, valid, invalid).
    """
    null, zero = F.lit(None).cast("bigint"), F.lit(0)

    def row(d, phase, i, kind, edge=null, fix=null):
        label, detail = _told(kind, F.col)
        return d.select("dataset_id", F.lit(phase).alias("phase"), i.cast("bigint").alias("i"), F.lit(kind).alias("kind"), label.alias("label"), detail.alias("detail"), edge.alias("edge_index"), fix.alias("repair_index"))

    d = row(graph, 0, zero, "graph").unionByName(row(path, 1, zero, "path")).unionByName(row(joins, 2, F.col("join_index"), "join", F.col("join_index")))
    d = d.unionByName(row(fixes, 3, F.col("i"), "repair", null, F.col("i").cast("bigint")))
    if form is not None:
        d = d.unionByName(row(form, 4, zero, "format"))
    seq = F.row_number().over(Window.partitionBy("dataset_id").orderBy("phase", "i")) - 1
    return d.withColumn("seq", seq.cast("bigint")).drop("phase", "i")


def timeline(traces: DataFrame) -> DataFrame:
    """The timeline of traces, as the viewer shows it: the events of _events(), each trace's in its row."""
    size = lambda c: F.size(f"trace.{c}")
    d = _joined(traces, fragments=size("fragments"), edges=size("edges"), steps=size("selected_path"), complete=F.col("trace.reconstruction.complete"), repairs=F.col("trace.repairs"), form=F.col("trace.format"))
    null = F.lit(None).cast("bigint")

    def event(kind, c, edge=null, fix=null):
        label, detail = _told(kind, c)
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), detail.alias("detail"), edge.alias("edge_index"), fix.alias("repair_index"))

    of_form = {"type": "type", "valid": "valid_crc_count", "invalid": "invalid_crc_count"}
    form = F.filter(F.array(event("format", lambda n: F.col("form")[of_form[n]])), lambda _: F.col("form.type") != "none")
    joins = F.transform("joins", lambda j: event("join", lambda n: j[n], j["join_index"]))
    fixes = F.transform("repairs", lambda r, i: event("repair", lambda n: r[n], null, i.cast("bigint")))
    d = d.select("dataset_id", F.posexplode(F.concat(F.array(event("graph", F.col), event("path", F.col)), joins, fixes, form)).alias("seq", "x"))
    return d.select("dataset_id", "x.*", F.col("seq").cast("bigint"))


def timeline_of(stats: DataFrame, totals: DataFrame, steps: DataFrame, consensus_repairs: DataFrame, crc_rows: DataFrame | None = None, analysis: DataFrame | None = None) -> DataFrame:
    """timeline() from the tables that a trace is made of, without the nested documents: no dataset's graph is gathered."""
    w = Window.partitionBy("dataset_id").orderBy("step_no")
    joins = steps.withColumn("src", F.lag("node_id").over(w)).where("src is not null")
    joins = joins.select("dataset_id", "src", F.col("node_id").alias("dst"), F.col("overlap_from_previous").alias("overlap"), "mismatches", "exact", (F.col("step_no") - 1).alias("join_index"))
    fix = lambda d, stage: d.select("dataset_id", "position", "before", "after", F.lit(stage).alias("stage"))
    fixes = fix(consensus_repairs, "consensus")
    if crc_rows is not None:
        fixes = fixes.unionByName(fix(crc_rows.where("kind <> 'unresolved'"), "png_crc"))
    fixes = fixes.withColumn("i", F.row_number().over(Window.partitionBy("dataset_id").orderBy("stage", "position")) - 1)
    form = None if analysis is None else analysis.select("dataset_id", F.lit("png").alias("type"), F.col("valid_crc_count").alias("valid"), F.col("invalid_crc_count").alias("invalid"))
    return _events(stats.select("dataset_id", F.col("nodes").alias("fragments"), "edges"), totals.select("dataset_id", F.col("n_steps").alias("steps"), "complete"), joins, fixes, form)


def inspector(traces: DataFrame) -> DataFrame:
    """(dataset_id, node_id, path_position, incoming, outgoing): degrees, and the place on the path or -1."""
    d = traces.select("dataset_id", F.col("trace.fragments.id").alias("ids"), F.col("trace.edges").alias("e"), F.col("trace.selected_path").alias("p"))
    d = d.select("dataset_id", "ids", _row_wise(_ways, "array<array<bigint>>", F.col("ids"), F.col("e.from"), F.col("e.to"), F.col("p")).alias("ways"))
    d = d.select("dataset_id", F.explode(F.arrays_zip("ids", "ways")).alias("f"))
    return d.select("dataset_id", F.col("f.ids").alias("node_id"), *[F.get("f.ways", F.lit(i)).alias(c) for i, c in ((2, "path_position"), (0, "incoming"), (1, "outgoing"))])


def repairs_by_stage(traces: DataFrame) -> DataFrame:
    """(dataset_id, consensus, png_crc): repairs of each stage."""
    n = lambda stage: F.size(F.filter("trace.repairs", lambda r: r["stage"] == stage)).cast("bigint").alias(stage)
    return traces.select("dataset_id", n("consensus"), n("png_crc"))


def mismatch_rows(traces: DataFrame) -> DataFrame:
    """The path's mismatches as the viewer shows them: offset and both bytes in hex."""
    d = traces.select("dataset_id", F.posexplode("trace.mismatches").alias("seq", "m"))
    return d.select("dataset_id", F.col("seq").cast("bigint"), F.col("m.from").alias("src"), F.col("m.to").alias("dst"), format_offset("m.overlap_offset").alias("offset"), format_byte("m.left_byte").alias("left"), format_byte("m.right_byte").alias("right"))
