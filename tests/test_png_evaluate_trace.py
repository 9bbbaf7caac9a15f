"""PNG structure and repair, metrics, traces, the verbs end to end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fragweave import cli
from fragweave.operators import evaluate, graph, png, repair, search, trace
from fragweave.operators.overlap import indexed_edges
from fragweave.plans import recover
from fragweave.sources import fragments as scan
from fragweave.sources import synthetic as syn
from tests.helpers import fragments

CODES = {
    "valid": [], "empty": ["invalid_signature"], "short_signature": ["invalid_signature"], "bad_signature": ["invalid_signature"],
    "truncated_header": ["truncated_chunk_header", "missing_ihdr", "missing_idat", "missing_iend"],
    "truncated_chunk": ["truncated_chunk", "missing_ihdr", "missing_idat", "missing_iend"],
    "huge_length": ["truncated_chunk", "missing_ihdr", "missing_idat", "missing_iend"],
    "idat_first": ["ihdr_not_first"], "duplicate_ihdr": ["duplicate_ihdr"], "short_ihdr": ["invalid_ihdr_length"], "zero_width": ["invalid_dimensions"],
    "no_idat": ["missing_idat"], "no_iend": ["missing_iend"], "iend_with_data": ["invalid_iend_length"], "trailing": ["trailing_data"], "crc": ["crc_mismatch"],
    "split_idat": ["nonconsecutive_idat"], "interlace": ["invalid_interlace_method"], "depth": ["invalid_color_type_bit_depth"],
    "methods": ["invalid_compression_method", "invalid_filter_method"], "chunk_type": ["invalid_chunk_type"],
}


def test_png_seeds(spark):
    seeds = syn.png_seeds()
    d = png.evidence(png.analyse(spark.createDataFrame(list(seeds.items()), "dataset_id string, data binary")))
    rows = {r.dataset_id: r for r in d.collect()}
    assert {k: [i.code for i in r.issues] for k, r in rows.items()} == CODES
    v = rows["valid"]
    assert v.structurally_valid and v.semantically_valid and v.all_crcs_valid and len(v.chunks) == 3
    assert (v.ihdr.width, v.ihdr.color_type, v.ranking_keys) == (1, 6, [1, 1, 0, 1, 1, 1, 1, 1, 3])
    assert not rows["crc"].all_crcs_valid and rows["crc"].structurally_valid and rows["crc"].ranking_keys[2] == -1
    assert not rows["depth"].semantically_valid and rows["depth"].structurally_valid
    assert not rows["zero_width"].structurally_valid and not rows["empty"].signature_valid
    for r in rows.values():
        assert r.valid_crc_count + r.invalid_crc_count == len(r.chunks)
        assert r.structurally_valid == (r.parsing_completed and not any(i.code_ord <= 13 for i in r.issues))


def test_walk_survives_anything():
    rng = random.Random(5)
    whole = syn.png_seeds()["split_idat"]
    for _ in range(2000):
        b = bytearray(whole[: rng.randrange(len(whole) + 1)])
        for _ in range(rng.randrange(4)):
            if b:
                b[rng.randrange(len(b))] = rng.randrange(256)
        _, _, chunks, _, issues = png.walk(bytes(b))
        assert all(c[1] + 12 + c[2] <= len(b) for c in chunks) and all(code in png.CODES for code, _ in issues)


def crc_case(spark, body, at, votes):
    data = bytearray(png.SIGNATURE + syn.png_chunk(b"IHDR", syn.png_header()) + syn.png_chunk(b"IDAT", body) + syn.png_chunk(b"IEND"))
    for p, v in at.items():
        data[p] = v
    files = spark.createDataFrame([(1, bytes(data))], "dataset_id long, data binary")
    a = spark.createDataFrame([(1, p, [(v, 1) for v in vs]) for p, vs in votes.items()], "dataset_id long, position long, votes array<struct<value:smallint,votes:bigint>>")
    fixed, rows = png.crc_repair(files, a)
    return bytes(data), bytes(fixed.first().data), {r.position: r for r in rows.collect()}, png.crc_summary(files, fixed, rows).first()


def test_crc_repair(spark):
    body, at = b"\xcc\x01\x02", 8 + 25 + 8  # the data of the second chunk
    before, after, rows, s = crc_case(spark, body, {at: 0x91}, {at: [0x91, 0xCC]})
    assert after[at] == 0xCC and (rows[at].kind, rows[at].candidates_tested, s.invalid_before, s.invalid_after) == ("repaired", 2, 1, 0)
    _, after, rows, _ = crc_case(spark, body, {}, {at: [0x91, 0xCC]})
    assert rows[at].kind == "corroborated" and after[at] == 0xCC
    _, _, rows, _ = crc_case(spark, body, {at: 0x91}, {at: [0x91, 0x92]})
    assert rows[at].reason == png.NO_MATCH
    _, _, rows, s = crc_case(spark, body, {}, {0: [1, 2], 8: [1, 2], at + 3: [1, 2]})
    assert {r.reason for r in rows.values()} == {png.OUTSIDE} and (s.eligible_ambiguous_bytes, s.unresolved) == (0, 3)
    _, _, rows, s = crc_case(spark, body, {at: 0x91}, {at: [0x91, 0xCC], at + 1: [1, 2]})
    assert {r.reason for r in rows.values()} == {png.SEVERAL} and s.chunks_evaluated == 0


def test_format_evidence_beats_overlap(spark):
    whole = syn.png_seeds()["valid"]
    cut = [whole[:34], whole[33:46], whole[45:58], whole[57:]]
    candidates = spark.createDataFrame([(1, 1, False, 4, 9, 0, cut[0] + cut[2]), (1, 2, False, 4, 3, 0, whole)], "dataset_id long, rank long, complete boolean, n_steps long, overlap long, mismatches long, data binary")
    d = search.rerank(candidates.drop("data"), png.candidate_evidence(candidates))
    assert {r.rank: r.new_rank for r in d.collect()} == {1: 2, 2: 1}


def evaluation(spark, path, sizes_off, roles, overlap=0):
    steps = spark.createDataFrame([(1, k, n, overlap if k else 0) for k, n in enumerate(path)], "dataset_id long, step_no long, node_id long, overlap_from_previous long")
    originals = spark.createDataFrame([(1, i, o, b"x" * n) for i, (o, n) in enumerate(sizes_off)], "dataset_id long, frag_id long, offset long, data binary")
    r = spark.createDataFrame([(1, i, *x) for i, x in enumerate(roles)], "dataset_id long, frag_id long, role string, source_frag_id long")
    emissions = spark.createDataFrame([(1, i, i) for i in range(len(roles))], "dataset_id long, node_id long, frag_id long")
    return steps, emissions, r, originals


def test_metrics(spark):
    roles = [("original", i) for i in range(4)] + [("duplicate", 0), ("noise", None)]
    parts = evaluation(spark, [0, 2, 1, 3, 4, 5], [(0, 4), (4, 4), (8, 4), (12, 4)], roles)
    original = spark.createDataFrame([(1, b"y" * 16)], "dataset_id long, data binary")
    m = evaluate.metrics(original, original, *parts).first()
    assert (m.exact_recovery, m.selected_originals, m.selected_duplicates, m.selected_noise, m.represented, m.ordered, m.comparable, m.size_delta) == (True, 4, 1, 1, 4, 5, 6, 0)
    assert m.genuine == 3 and m.consistent == 0
    shorter = spark.createDataFrame([(1, b"y" * 15)], "dataset_id long, data binary")
    m = evaluate.metrics(original, shorter, *parts)
    assert m.first().size_delta == -1
    with pytest.raises(Exception, match="ground truth"):
        evaluate.metrics(original, original, *evaluation(spark, [0], [(0, 4)], [("dropped", 0)])).collect()
    nothing = spark.createDataFrame([(2, b"")], "dataset_id long, data binary")
    e = evaluate.metrics(nothing, nothing, *parts)
    r = e.first()
    assert r.exact_recovery and r.recall is None and r.order_accuracy is None and r.noise_rate is None
    a = evaluate.aggregate(m.unionByName(e)).first()
    assert (a.runs, a.exact_runs, a.mean_recall, a.mean_selected_noise) == (2, 1, 1.0, 0.5) and a.mean_order_accuracy == pytest.approx(5 / 6)


def traced(spark):
    nodes = fragments(spark, [bytes([1, 2, 3, 4, 5]), bytes([3, 9, 5, 6, 7])])
    edges = graph.with_paths(indexed_edges(nodes, 3, 1), nodes)
    steps = search.greedy(nodes, edges)
    config = graph.GraphConfig(3, 1)
    merged = search.materialise(steps, nodes)
    _, pos = repair.consensus(steps, nodes, merged)
    return trace.build(nodes, graph.ranked(edges), steps, search.totals(steps, nodes), graph.statistics(nodes, edges, config), trace.TraceConfig(3, 1, repair="consensus"), pos)


def test_trace_round_trip(spark):
    t = trace.to_json(traced(spark))
    text = t.first().json
    v = json.loads(text)
    assert v["schema_version"] == 1 and v["selected_path"] == [0, 1]
    assert [(e["exact"], [m["overlap_offset"] for m in e["mismatch_details"]]) for e in v["edges"]] == [(False, [1])]
    assert v["format"]["width"] is None and v["mismatches"] == [{"from": 0, "to": 1, "overlap_offset": 1, "left_byte": 4, "right_byte": 9}]
    assert v["unresolved_ambiguities"] == 1 and "offset" not in v["fragments"][0]
    bad = {
        "not a JSON object": ["{", "[1]", "7", ""],
        "unsupported": [text.replace('"schema_version":1', '"schema_version":2'), "{}"],
        "arrays": [json.dumps({k: x for k, x in v.items() if k != drop}) for drop in ("fragments", "edges", "selected_path")],
        "summary": [json.dumps({k: x for k, x in v.items() if k != "format"})],
        "metadata": [json.dumps(v | {"fragments": [{"id": 0, "name": None, "size": 1}, v["fragments"][1]]})],
        "path has": [json.dumps(v | {"selected_path": [0, 7]})],
        "edge has": [json.dumps(v | {"edges": [v["edges"][0] | {"to": 9}]})],
    }
    rows = [(f"{k}|{i}", x) for k, xs in bad.items() for i, x in enumerate(xs)] + [("ok|0", text)]
    got = {r.dataset_id: r for r in trace.parse(spark.createDataFrame(rows, "dataset_id string, json string")).collect()}
    for k, r in got.items():
        assert (r.error is None and r.trace is not None) if k == "ok|0" else (k.split("|")[0] in r.error and r.trace is None), (k, r.error)


def test_viewer(spark):
    edge = lambda a, b, miss=0: {"from": a, "to": b, "overlap": 9, "matches": 9 - miss, "mismatches": miss, "exact": not miss, "mismatch_details": []}
    base = json.loads(trace.to_json(traced(spark)).first().json)
    v = base | {"fragments": [{"id": i, "name": f"f{i}", "size": 1} for i in range(6)], "selected_path": [1, 0, 2, 3], "edges": [edge(0, 2, 2), edge(1, 0), edge(2, 3), edge(3, 1, 1)], "repairs": [{"position": 42, "stage": "consensus", "before": 1, "after": 2, "support": 2, "observations": 3, "candidates_tested": 0, "crc_consistent": False}]}
    t = trace.parse(spark.createDataFrame([(1, json.dumps(v))], "dataset_id long, json string")).select("dataset_id", "trace").cache()
    assert [r.pair for r in trace.selected_pairs(t).orderBy("place").collect()] == ["1->0", "0->2", "2->3"]
    assert {(r.src, r.dst): r.join_index for r in trace.join_indices(t).collect()} == {(1, 0): 0, (0, 2): 1, (2, 3): 2, (3, 1): -1}
    near = {r.join_index: (r.previous, r.next) for r in trace.adjacent_joins(t, True).collect()}
    assert near == {0: (None, 1), 1: (None, None), 2: (1, None)}
    assert {r.join_index: r.next for r in trace.adjacent_joins(t).collect()} == {0: 1, 1: 2, 2: None}
    off = trace.filter_edges(t, exact=False, path=False)
    assert [(r.src, r.l) for r in off.withColumn("l", trace.edge_label()).collect()] == [(3, "9 B · 1 mismatch")]
    assert trace.filter_edges(t, approximate=False).count() == 2
    assert {r.node_id: (r.x, r.y) for r in trace.layout(t).collect()} == {1: (80, 70), 0: (310, 70), 2: (540, 70), 3: (770, 70), 4: (120, 210), 5: (340, 210)}
    line = trace.timeline(t).orderBy("seq").collect()
    assert [r.kind for r in line] == ["graph", "path", "join", "join", "join", "repair"]
    assert line[3].label == "JOIN 02 · F0 → F2" and line[3].detail == "9 B · Approximate · 2 mismatches" and line[5].detail == "Offset 0x2A · 1 → 2"
    assert {r.node_id: (r.incoming, r.outgoing, r.path_position) for r in trace.inspector(t).collect()}[3] == (1, 1, 3)
    assert trace.repairs_by_stage(t).first().consensus == 1


def test_load_order(spark, tmp_path):
    for name in ("b", "B", "a_1", "é"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "below").mkdir()
    rows = scan.load_directory(spark, str(tmp_path)).orderBy("node_id").collect()
    assert [r.filename for r in rows] == ["B", "a_1", "b", "é"]
    (tmp_path / "none").mkdir()
    assert scan.load_directory(spark, str(tmp_path / "none"), io="mmap").count() == 0
    for bad in (tmp_path / "gone", tmp_path / "b"):
        with pytest.raises(ValueError):
            scan.load_directory(spark, str(bad))


def test_verbs(spark, tmp_path, capsys):
    source = random.Random(1).randbytes(700)
    (tmp_path / "in").write_bytes(source)
    pieces, out, report, view = (str(tmp_path / x) for x in ("pieces", "out", "report.tsv", "trace.json"))
    assert cli.run(["inspect", str(tmp_path / "in")], spark) == 0
    assert f"size: 700\npreview: {source[:16].hex()}" in capsys.readouterr().out
    assert cli.run(["fragment", str(tmp_path / "in"), "--size", "100", "--overlap", "60", "--shuffle", "--opaque-names", "--seed", "4", "--output", pieces], spark) == 0
    assert cli.run(["analyze", pieces, "--min-overlap", "30", "--graph-build", "indexed"], spark) == 0
    assert "60 bytes" in capsys.readouterr().out
    options = ["reconstruct", pieces, "--min-overlap", "30", "--strategy", "beam", "--beam-width", "4", "--repair", "consensus", "--repair-report", report, "--trace-json", view, "--output", out]
    assert cli.run(options, spark) == 0
    assert (tmp_path / "out").read_bytes() == source
    assert (tmp_path / "report.tsv").read_text().startswith("status\tposition\tstage")
    assert json.loads((tmp_path / "trace.json").read_text())["reconstruction"]["complete"] is True
    (tmp_path / "pieces" / "stray.bin").write_bytes(bytes(80))
    assert cli.run(options, spark) == 2
    for bad in (["--format", "png"], ["--beam-width", "2"], ["--repair-report", "x"]):
        with pytest.raises(ValueError):
            cli.run(["reconstruct", pieces, "--output", out, *bad], spark)
    with pytest.raises(ValueError):
        recover.FragmentOptions(10, seed=3)


def test_png_verb(spark, tmp_path):
    body = random.Random(2).randbytes(300)
    whole = png.SIGNATURE + syn.png_chunk(b"IHDR", syn.png_header()) + syn.png_chunk(b"IDAT", body) + syn.png_chunk(b"IEND")
    payload = spark.createDataFrame([(0, whole)], "dataset_id long, data binary")
    out = recover.fragment(payload, recover.FragmentOptions(64, 32, True, True, 9))
    nodes = scan.with_node_ids(out.fragments.drop("offset", "position"))
    r = recover.reconstruct(nodes, recover.ReconstructOptions(16, 0, "indexed", strategy="beam", beam_width=4, format="png", repair="png"))
    assert bytes(r.output.first().data) == whole and r.partial().count() == 0
    assert r.traces.first().trace.format.all_crc_valid
    assert syn.dataset(spark, 7, 32, 8, 3, 2).groupBy("dataset_id").agg(F.count("*").alias("n"), F.max(F.length("data")).alias("s")).distinct().count() == 2
