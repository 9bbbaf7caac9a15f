"""Command line: python -m fragweave.cli inspect|fragment|analyze|reconstruct. Exit status 0, 1 on errors, 2 for partial output."""

from __future__ import annotations

import argparse
import sys

from fragweave.operators import damage as dmg
from fragweave.operators import graph, trace
from fragweave.plans import recover
from fragweave.session import local_session
from fragweave.sources import fragments, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fragweave", description="Recovers files from shuffled, overlapping, damaged fragments.")
    p.add_argument("--version", action="version", version="fragweave 0.1")
    sub = p.add_subparsers(dest="verb", required=True)
    number = lambda name, least=1: lambda s: recover.positive(s, name, least)
    i = sub.add_parser("inspect")
    i.add_argument("file")
    f = sub.add_parser("fragment")
    f.add_argument("input")
    f.add_argument("--size", type=number("size"), required=True)
    f.add_argument("--output", required=True)
    for k in ("overlap", "duplicates", "noise", "drop", "corrupt-bytes"):
        f.add_argument(f"--{k}", type=number(k, 0), default=0)
    f.add_argument("--seed", type=number("seed", 0))
    f.add_argument("--shuffle", action="store_true")
    f.add_argument("--opaque-names", action="store_true")
    for verb in ("analyze", "reconstruct"):
        a = sub.add_parser(verb)
        a.add_argument("folder")
        a.add_argument("--min-overlap", type=number("min-overlap"), default=1)
        a.add_argument("--max-mismatches", type=number("max-mismatches", 0), default=0)
        a.add_argument("--graph-build", choices=("exhaustive", "indexed"), default="exhaustive")
        a.add_argument("--threads", type=number("threads"), default=1)
        a.add_argument("--io", choices=fragments.IO, default="buffered")
        if verb == "analyze":
            a.add_argument("--top", type=number("top"), default=20)
        else:
            a.add_argument("--strategy", choices=("greedy", "beam"), default="greedy")
            a.add_argument("--beam-width", type=number("beam-width"))
            a.add_argument("--candidates", type=number("candidates"))
            a.add_argument("--format", choices=("none", "png"), default="none")
            a.add_argument("--repair", choices=("none", "consensus", "png"), default="none")
            a.add_argument("--repair-report")
            a.add_argument("--trace-json")
            a.add_argument("--output", required=True)
    return p


def run(argv: list[str], spark=None) -> int:
    """The command; returns the exit status."""
    a = _parser().parse_args(argv)
    say = lambda **row: print(sinks.summary(row))
    if a.verb == "fragment":
        damage = dmg.DamageConfig(a.drop, a.duplicates, a.noise, a.corrupt_bytes, a.seed or 0)
        options = recover.FragmentOptions(a.size, a.overlap, a.shuffle, a.opaque_names, a.seed, damage)
    elif a.verb == "reconstruct":
        options = recover.ReconstructOptions(a.min_overlap, a.max_mismatches, a.graph_build, a.threads, a.io, a.strategy, a.beam_width, a.candidates, a.format, a.repair, a.repair_report is not None)
    spark = spark or local_session()
    if a.verb == "inspect":
        r = fragments.inspect(fragments.load_file(spark, a.file)).first()
        say(file=r.filename, size=r.size, preview=r.preview)
        return 0
    if a.verb == "fragment":
        out = recover.fragment(fragments.load_file(spark, a.input), options)
        say(fragments=sinks.write_files(out.fragments, a.output), changed_bytes=out.changes.count(), output=a.output)
        return 0
    if a.verb == "analyze":
        nodes = fragments.load_directory(spark, a.folder, io=a.io)
        edges, stats = recover.analyse(nodes, graph.GraphConfig(a.min_overlap, a.max_mismatches, a.graph_build, a.threads), a.top)
        for r in stats.collect():
            say(**r.asDict())
        for r in edges.orderBy("dataset_id", "rank").collect():
            print(f"{r.src_path} -> {r.dst_path}: {r.overlap} bytes, {r.mismatches} mismatches, {100 * r.matches / r.overlap:.2f} %")
        return 0
    r = recover.reconstruct_directory(spark, a.folder, options)
    with open(a.output, "wb") as f:
        f.write(bytes(r.output.first().data))
    if a.repair_report:
        rows = r.report.orderBy("seq").collect()
        with open(a.repair_report, "w", encoding="utf-8") as f:
            f.write("\t".join(("status", "position", "stage", "baseline", "result", "evidence")) + "\n")
            f.writelines("\t".join(map(str, (x.status, x.position, x.stage, x.baseline, x.result, x.evidence))) + "\n" for x in rows)
    if a.trace_json:
        with open(a.trace_json, "w", encoding="utf-8") as f:
            f.write(trace.to_json(r.traces).first().json + "\n")
    total = r.totals.first()
    say(**{k: v for k, v in total.asDict().items() if k != "dataset_id"}, output=a.output)
    if r.candidates is not None:
        place = "new_rank" if "new_rank" in r.candidates.columns else "rank"
        for c in r.candidates.where(f"{place} <= {a.candidates or 3}").orderBy(place).collect():
            print(f"candidate {c[place]}: {'complete' if c.complete else 'partial'}, {c.n_steps} fragments, overlap {c.overlap}, mismatches {c.mismatches}")
    return 0 if total.complete else 2


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
