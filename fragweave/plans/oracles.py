"""DuckDB SQL for the queries of the catalogue, written from the semantics and not from the plans.

The one lemma shared with the plans is that of tolerant edges: candidates come from k + 1 blocks, since
all lengths of all pairs take minutes here. Tests hold it against all lengths on small tables.

Payloads are upper-case hex: byte i (0-based) is substr(h, 2 * i + 1, 2). The recovery scenario
is one chain of common table expressions; each query takes the part of it that it needs.
"""

from __future__ import annotations

import re

from fragweave.operators import png
from fragweave.plans import scenarios as sc

_S, _O, _M, _K = sc.SIZE, sc.OVERLAP, sc.LEAST, sc.MISSES
_D = sc.DAMAGE
_HALF = _M // (_K + 1)


def _draw(seed: int, purpose: str, *parts: str) -> str:
    joined = " || ':' || ".join([f"'{seed}:{purpose}'", *parts])
    return f"('0x' || substr(md5({joined}), 1, 15))::BIGINT"


def _md5(seed: int, purpose: str, *parts: str) -> str:
    return f"md5({' || \':\' || '.join([f"\'{seed}:{purpose}\'", *parts])})"


#: name -> body; a body refers to earlier names only.
_PARTS = {
    "src": "SELECT doc_id AS ds, hex(text) AS h FROM documents WHERE text IS NOT NULL",
    "sh": f"""SELECT ds, i AS id, i * {_S - _O} AS off, substr(h, {2 * (_S - _O)} * i + 1, {2 * _S}) AS h FROM (
      SELECT ds, h, unnest(range(CASE WHEN len(h) = 0 THEN 0 ELSE 1 + greatest(0, ceil((len(h) // 2 - {_S}) / {_S - _O}.0))::BIGINT END)) AS i FROM src)""",
    # damage: copies, then noise, then changed bytes
    "dup": f"""SELECT p.ds, p.mx + 1 + p.j AS id, s.off, s.h, s.id AS source FROM (
        SELECT ds, j, mx, {_draw(_D.seed, "duplicate", "ds", "j")} % n AS k FROM (
          SELECT ds, count(*) AS n, max(id) AS mx, unnest(range({_D.duplicate})) AS j FROM sh GROUP BY ds)) p
      JOIN (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY id) - 1 AS k FROM sh) s ON s.ds = p.ds AND s.k = p.k""",
    "clean": "SELECT ds, id, off, h FROM sh UNION ALL SELECT ds, id, off, h FROM dup",
    "noise": f"""SELECT ds, nxt + j AS id, 0::BIGINT AS off, substr(array_to_string(list_transform(range((n - 1) // 16 + 1), lambda b: upper({_md5(_D.seed, "noise", "ds", "j", "b")})), ''), 1, 2 * n) AS h FROM (
      SELECT ds, nxt, j, lo + {_draw(_D.seed, "noise-size", "ds", "j")} % (hi - lo + 1) AS n FROM (
        SELECT ds, nxt, lo, hi, unnest(range({_D.noise})) AS j FROM (SELECT ds, greatest(1, min(len(h) // 2)) AS lo, max(len(h) // 2) AS hi FROM sh GROUP BY ds) JOIN (SELECT ds, max(id) + 1 AS nxt FROM clean GROUP BY ds) USING (ds)))""",
    "flat": "SELECT ds, id, h, len(h) // 2 AS n, sum(len(h) // 2) OVER (PARTITION BY ds ORDER BY id) AS e FROM clean",
    "chg": f"""SELECT ds, id, b, old, xor(old, 1 + {_draw(_D.seed, "corrupt-value", "ds", "j")} % 255) AS new FROM (
      SELECT p.ds, p.j, f.id, (p.pos - f.e + f.n)::BIGINT AS b, ('0x' || substr(f.h, 2 * (p.pos - f.e + f.n)::BIGINT + 1, 2))::BIGINT AS old FROM (
        SELECT ds, j, (j * t) // {_D.corrupt} + {_draw(_D.seed, "corrupt", "ds", "j")} % (((j + 1) * t) // {_D.corrupt} - (j * t) // {_D.corrupt}) AS pos FROM (
          SELECT ds, max(e)::BIGINT AS t, unnest(range({_D.corrupt})) AS j FROM flat GROUP BY ds)) p
      JOIN flat f ON f.ds = p.ds AND p.pos < f.e AND p.pos >= f.e - f.n)""",
    "bad": "SELECT ds, id, list(b) AS bs, list(printf('%02X', new::BIGINT)) AS vs FROM chg GROUP BY ds, id",
    "dmg": """SELECT c.ds, c.id, c.off, CASE WHEN bs IS NULL THEN c.h ELSE
        array_to_string(list_transform(range(len(c.h) // 2), lambda i: coalesce(vs[list_position(bs, i)], substr(c.h, 2 * i + 1, 2))), '') END AS h
      FROM clean c LEFT JOIN bad USING (ds, id) UNION ALL SELECT ds, id, off, h FROM noise""",
    "roles": """SELECT ds, id, 'original' AS role, id AS source FROM sh UNION ALL SELECT ds, id, 'duplicate', source FROM dup UNION ALL SELECT ds, id, 'noise', NULL FROM noise""",
    # scan and graph
    "nd": f"""SELECT ds, id AS frag, name, h, len(h) // 2 AS n, row_number() OVER (PARTITION BY ds ORDER BY name) - 1 AS id FROM (
      SELECT ds, id, h, 'shard_' || substr({_md5(_D.seed, "name", "ds", "id")}, 1, 16) || '.bin' AS name FROM dmg)""",
    "lg": f"SELECT ds, id, n, p, substr(h, 2 * p + 1, {2 * _HALF}) AS g FROM (SELECT ds, id, n, h, unnest(range(n - {_HALF} + 1)) AS p FROM nd WHERE n >= {_M})",
    "rg": f"SELECT ds, id, n, j, substr(h, {2 * _HALF} * j + 1, {2 * _HALF}) AS g FROM (SELECT ds, id, n, h, unnest(range({_K + 1})) AS j FROM nd WHERE n >= {_M})",
    "cand": f"""SELECT DISTINCT l.ds, l.id AS src, r.id AS dst, l.n - l.p + {_HALF} * r.j AS n FROM lg l JOIN rg r ON l.ds = r.ds AND l.g = r.g AND l.id <> r.id
      WHERE l.p >= {_HALF} * r.j AND l.n - l.p + {_HALF} * r.j BETWEEN {_M} AND least(l.n, r.n)""",
    "ver": """SELECT c.*, CASE WHEN substr(l.h, 2 * (l.n - c.n) + 1) = substr(r.h, 1, 2 * c.n) THEN [] ELSE
        list_filter(range(c.n), lambda i: substr(l.h, 2 * (l.n - c.n + i) + 1, 2) <> substr(r.h, 2 * i + 1, 2)) END AS bad
      FROM cand c JOIN nd l ON l.ds = c.ds AND l.id = c.src JOIN nd r ON r.ds = c.ds AND r.id = c.dst""",
    "ed": f"""SELECT ds, src, dst, n, bad FROM (
      SELECT *, row_number() OVER (PARTITION BY ds, src, dst ORDER BY len(bad) > 0, n DESC) AS k FROM ver WHERE len(bad) <= {_K}) WHERE k = 1""",
    "e": "SELECT ed.ds, src, dst, ed.n AS overlap, ed.n - len(bad) AS matches, len(bad) AS mismatches, len(bad) = 0 AS exact, bad, s.name AS sp, d.name AS dp FROM ed JOIN nd s ON s.ds = ed.ds AND s.id = src JOIN nd d ON d.ds = ed.ds AND d.id = dst",
    "er": "SELECT *, row_number() OVER (PARTITION BY ds ORDER BY overlap DESC, mismatches, sp, dp, src, dst) AS rank FROM e",
    "deg": """SELECT nd.ds, nd.id, nd.name, coalesce(i.c, 0) AS ic, coalesce(i.s, 0)::BIGINT AS isum, coalesce(o.c, 0) AS oc, coalesce(o.m, 0) AS om FROM nd
      LEFT JOIN (SELECT ds, dst AS id, count(*) AS c, sum(overlap) AS s FROM e GROUP BY ALL) i USING (ds, id)
      LEFT JOIN (SELECT ds, src AS id, count(*) AS c, max(overlap) AS m FROM e GROUP BY ALL) o USING (ds, id)""",
    "st": "SELECT ds, id FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY ic, isum, om DESC, name, id) AS k FROM deg) WHERE k = 1",
    "adj": "SELECT ds, src, list(dst ORDER BY overlap DESC, mismatches, sp, dp, dst) AS out FROM e GROUP BY ALL",
    # greedy search: the first neighbour that the path doesn't hold yet
    "walk": """SELECT ds, [id] AS path, id AS a0 FROM st UNION ALL
      SELECT ds, list_append(path, nxt), nxt FROM (
        SELECT w.ds, w.path, list_filter(adj.out, lambda x: NOT list_contains(w.path, x))[1] AS nxt FROM walk w JOIN adj ON adj.ds = w.ds AND adj.src = w.a0) WHERE nxt IS NOT NULL""",
    # beam search: a level's states with all their children; what completes a path ends it, else the best stay
    "beam0": "SELECT ds, id FROM deg WHERE ic = 0 UNION ALL SELECT ds, id FROM st WHERE ds NOT IN (SELECT ds FROM deg WHERE ic = 0)",
    "nexts": "SELECT ds, src, list({'d': dst, 'o': overlap, 'm': mismatches, 'x': exact}) AS o FROM e GROUP BY ALL",
    "beam": f"""SELECT ds, 0 AS lv, [id] AS pth, 0::BIGINT AS ov, 0::BIGINT AS miss, [0::BIGINT] AS ovs, 0::BIGINT AS app, n, gen, n = 1 AS fin FROM (
        SELECT b.ds, b.id, c.n, count(*) OVER (PARTITION BY b.ds) AS gen, row_number() OVER (PARTITION BY b.ds ORDER BY b.id) AS k FROM beam0 b JOIN (SELECT ds, count(*) AS n FROM nd GROUP BY ds) c ON c.ds = b.ds) WHERE k <= {sc.WIDTH}
      UNION ALL SELECT ds, lv + 1, pth, ov, miss, ovs, app, n, gen, fin FROM (
        SELECT *, bool_or(whole) OVER (PARTITION BY ds) AS stop, count(x) OVER (PARTITION BY ds) AS gen, x IS NULL OR whole AS fin, row_number() OVER (PARTITION BY ds, x IS NULL OR whole ORDER BY ov DESC, miss, pth) AS k FROM (
          SELECT ds, lv, n, x, CASE WHEN x IS NULL THEN pth ELSE list_append(pth, x.d) END AS pth, ov + coalesce(x.o, 0) AS ov, miss + coalesce(x.m, 0) AS miss, CASE WHEN x IS NULL THEN ovs ELSE list_append(ovs, x.o) END AS ovs,
            app + CASE WHEN x IS NULL OR x.x THEN 0 ELSE 1 END AS app, x IS NOT NULL AND len(pth) + 1 = n AS whole FROM (
            SELECT * EXCLUDE (c), unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END) AS x FROM (
              SELECT w.ds, w.lv, w.n, w.pth, w.ov, w.miss, w.ovs, w.app, coalesce(list_filter(nexts.o, lambda z: NOT list_contains(w.pth, z.d)), []) AS c
              FROM beam w LEFT JOIN nexts ON nexts.ds = w.ds AND nexts.src = w.pth[-1] WHERE NOT w.fin)))) WHERE fin OR (NOT stop AND k <= {sc.WIDTH})""",
    "ends": "SELECT *, len(pth) = n AS done, row_number() OVER (PARTITION BY ds ORDER BY len(pth) < n, len(pth) DESC, ov DESC, miss, pth) AS place FROM beam WHERE fin",
    "tally": "SELECT ds, sum(g)::BIGINT AS made, max(b) AS wide, sum(grew)::BIGINT AS grew FROM (SELECT ds, lv, max(gen) AS g, count(*) FILTER (NOT fin OR lv = 0) AS b, count(*) FILTER (NOT fin) AS grew FROM beam GROUP BY ds, lv) GROUP BY ds",
    "path": "SELECT ds, arg_max(path, len(path)) AS path FROM walk GROUP BY ds",
    "stp0": "SELECT ds, path[k + 1] AS id, CASE WHEN k > 0 THEN path[k] END AS prev, k FROM (SELECT ds, path, unnest(range(len(path))) AS k FROM path)",
    "stp": """SELECT s.ds, s.k, s.id, s.prev, coalesce(e.overlap, 0) AS overlap, coalesce(e.matches, 0) AS matches, coalesce(e.mismatches, 0) AS mismatches, coalesce(e.exact, true) AS exact, nd.n, nd.h, nd.frag
      FROM stp0 s JOIN nd USING (ds, id) LEFT JOIN e ON e.ds = s.ds AND e.src = s.prev AND e.dst = s.id""",
    "mrg": "SELECT ds, string_agg(substr(h, 2 * overlap + 1), '' ORDER BY k) AS h FROM stp GROUP BY ds",
    "tot": "SELECT ds, count(*) AS n_steps, sum(overlap)::BIGINT AS overlap, sum(mismatches)::BIGINT AS mismatches, count(*) FILTER (NOT exact) AS approximate_joins, sum(n - overlap)::BIGINT AS size, count(*) = (SELECT count(*) FROM nd WHERE nd.ds = stp.ds) AS complete FROM stp GROUP BY ds",
    # repair
    "pl": "SELECT ds, k, id, h, n, sum(n - overlap) OVER (PARTITION BY ds ORDER BY k)::BIGINT - n AS a0 FROM stp",
    "vote0": "SELECT ds, a0 + i AS pos, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS v FROM (SELECT ds, a0, h, unnest(range(n)) AS i FROM pl)",
    "vote": "SELECT ds, pos, v, c FROM (SELECT ds, pos, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY ds, pos) AS t FROM vote0 GROUP BY ds, pos, v) WHERE t >= 2",
    "po": """SELECT p.*, ('0x' || substr(mrg.h, 2 * pos + 1, 2))::BIGINT AS old, CASE WHEN 2 * support > obs THEN win ELSE ('0x' || substr(mrg.h, 2 * pos + 1, 2))::BIGINT END AS new,
        CASE WHEN 2 * support <= obs THEN 'ambiguous' WHEN win <> ('0x' || substr(mrg.h, 2 * pos + 1, 2))::BIGINT THEN 'repaired' ELSE 'corroborated' END AS kind
      FROM (SELECT ds, pos, sum(c)::BIGINT AS obs, count(*) AS kinds, max(c) AS support, arg_min(v, -c * 1000 + v) AS win, string_agg(printf('%02x', v) || ':' || c, ',' ORDER BY v) AS votes FROM vote GROUP BY ds, pos) p JOIN mrg USING (ds)""",
    "fix": "SELECT ds, list(pos) AS ps, list(printf('%02X', new)) AS vs FROM po WHERE kind = 'repaired' GROUP BY ds",
    "rep": "SELECT mrg.ds, CASE WHEN ps IS NULL THEN h ELSE array_to_string(list_transform(range(len(h) // 2), lambda i: coalesce(vs[list_position(ps, i)], substr(h, 2 * i + 1, 2))), '') END AS h FROM mrg LEFT JOIN fix USING (ds)",
    # evaluation
    "sel": "SELECT s.ds, s.k, s.overlap, r.role, r.source, CASE WHEN r.role = 'original' THEN o.off END AS off, CASE WHEN r.role = 'original' THEN len(o.h) // 2 END AS n FROM stp s JOIN roles r ON r.ds = s.ds AND r.id = s.frag LEFT JOIN sh o ON o.ds = s.ds AND o.id = s.frag",
    "met": """SELECT src.ds, src.h = coalesce(rep.h, '') AS exact_recovery, len(src.h) // 2 AS original_bytes, len(coalesce(rep.h, '')) // 2 AS reconstructed_bytes,
        coalesce(a.o, 0) AS selected_originals, coalesce(a.d, 0) AS selected_duplicates, coalesce(a.z, 0) AS selected_noise, coalesce(a.rep, 0) AS represented,
        coalesce(r.o, 0) AS surviving, coalesce(r.z, 0) AS emitted_noise, coalesce(p.c, 0) AS comparable, coalesce(p.o, 0) AS ordered, coalesce(j.g, 0) AS genuine, coalesce(j.c, 0) AS consistent, coalesce(f.n, 0) AS repair_events
      FROM src LEFT JOIN rep USING (ds)
      LEFT JOIN (SELECT ds, count(*) FILTER (role = 'original') AS o, count(*) FILTER (role = 'duplicate') AS d, count(*) FILTER (role = 'noise') AS z, count(DISTINCT source) AS rep FROM sel GROUP BY ds) a USING (ds)
      LEFT JOIN (SELECT ds, count(*) FILTER (role = 'original') AS o, count(*) FILTER (role = 'noise') AS z FROM roles GROUP BY ds) r USING (ds)
      LEFT JOIN (SELECT x.ds, count(*) AS c, count(*) FILTER (x.off < y.off) AS o FROM sel x JOIN sel y ON x.ds = y.ds AND x.k < y.k AND x.source <> y.source AND x.off <> y.off GROUP BY x.ds) p USING (ds)
      LEFT JOIN (SELECT x.ds, count(*) AS g, count(*) FILTER (y.off = x.off + x.n - y.overlap) AS c FROM sel x JOIN sel y ON x.ds = y.ds AND y.k = x.k + 1 WHERE x.off IS NOT NULL AND y.off IS NOT NULL GROUP BY x.ds) j USING (ds)
      LEFT JOIN (SELECT ds, count(*) AS n FROM po WHERE kind = 'repaired' GROUP BY ds) f USING (ds)""",
    # the trace's edges by place, and the path's joins
    "te": "SELECT *, rank - 1 AS idx FROM er",
    "pe": "SELECT te.*, row_number() OVER (PARTITION BY te.ds ORDER BY stp0.k) - 1 AS ji FROM stp0 JOIN te ON te.ds = stp0.ds AND te.src = stp0.prev AND te.dst = stp0.id",
}
_NAMED = {n: set(re.findall(r"\b\w+\b", b)) & (_PARTS.keys() - {n}) for n, b in _PARTS.items()}
#: Parts that several others read.
_HEAVY = {"beam", "ends", "sh", "dmg", "nd", "cand", "ver", "e", "er", "path", "stp", "mrg", "vote", "po", "rep", "sel"}


def _with(select: str) -> str:
    need, todo = set(), [n for n in re.findall(r"\b\w+\b", select) if n in _PARTS]
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += _NAMED[n]
    parts = [f"{n} AS {'MATERIALIZED ' if n in _HEAVY else ''}({b})" for n, b in _PARTS.items() if n in need]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"


def _scenario() -> dict[str, str]:
    edge = "ds AS dataset_id, src, dst, overlap, matches, mismatches, exact"
    return {
        "shard_documents": "SELECT ds AS dataset_id, id AS frag_id, off AS offset, h AS data FROM sh",
        "shard_stats": "SELECT ds AS dataset_id, count(*) AS fragments, sum(len(h) // 2)::BIGINT AS total_bytes, min(len(h) // 2) AS least, max(len(h) // 2) AS largest, avg(len(h) // 2) AS mean_bytes FROM sh GROUP BY ds",
        "inspect_preview": "SELECT ds AS dataset_id, len(h) // 2 AS size, CASE WHEN h = '' THEN '<empty>' ELSE lower(substr(h, 1, 32)) END AS preview FROM src",
        "load_order": "SELECT ds AS dataset_id, 'fragment_' || lpad(id::VARCHAR, greatest(4, len((max(id) OVER (PARTITION BY ds))::VARCHAR))::INTEGER, '0') || '.bin' AS filename, id AS node_id, id AS frag_id, len(h) // 2 AS size FROM sh",
        "edges_indexed": _clean_edges("SELECT ds AS dataset_id, src, dst, n AS overlap, n AS matches, 0::BIGINT AS mismatches, true AS exact FROM ce"),
        "top_edges": _clean_edges("""SELECT * FROM (SELECT ds AS dataset_id, src, dst, n AS overlap, n AS matches, 0::BIGINT AS mismatches, true AS exact,
            row_number() OVER (PARTITION BY ds ORDER BY n DESC, src, dst)::INTEGER AS rank, 100.0::DOUBLE AS similarity FROM ce) WHERE rank <= 20"""),
        "edges_tolerant": f"SELECT {edge} FROM e",
        "edge_mismatches": """SELECT ds AS dataset_id, src, dst, i AS overlap_offset, ('0x' || substr(lh, 2 * (ln - overlap + i) + 1, 2))::SMALLINT AS left_byte, ('0x' || substr(rh, 2 * i + 1, 2))::SMALLINT AS right_byte
          FROM (SELECT e.ds, src, dst, overlap, unnest(bad) AS i, l.h AS lh, l.n AS ln, r.h AS rh FROM e JOIN nd l ON l.ds = e.ds AND l.id = src JOIN nd r ON r.ds = e.ds AND r.id = dst)""",
        "graph_stats": """SELECT ds AS dataset_id, n AS nodes, n * (n - 1) AS theoretical_pairs, n * (n - 1) AS candidate_pairs, n * (n - 1) AS full_checks, coalesce(c, 0) AS edges, coalesce(x, 0) AS exact_edges, coalesce(c - x, 0) AS approximate_edges,
            'indexed' AS requested_strategy, 'exhaustive' AS effective_strategy, true AS approximate_fallback, 1::BIGINT AS threads_used
          FROM (SELECT ds, count(*) AS n FROM nd GROUP BY ds) LEFT JOIN (SELECT ds, count(*) AS c, count(*) FILTER (exact) AS x FROM e GROUP BY ds) USING (ds)""",
        "node_degrees": "SELECT ds AS dataset_id, id AS node_id, ic AS in_count, isum AS in_overlap_sum, oc AS out_count, om AS max_out_overlap FROM deg",
        "adjacency": "SELECT ds AS dataset_id, src AS node_id, array_to_string(out, ',') AS neighbours FROM adj",
        "start_nodes": "SELECT ds AS dataset_id, id AS node_id FROM st",
        "beam_starts": "SELECT ds AS dataset_id, id AS node_id FROM deg WHERE ic = 0 UNION ALL SELECT ds, id FROM st WHERE ds NOT IN (SELECT ds FROM deg WHERE ic = 0)",
        "greedy_path": "SELECT ds AS dataset_id, k AS step_no, id AS node_id, overlap AS overlap_from_previous, matches, mismatches, exact FROM stp",
        "greedy_output": "SELECT ds AS dataset_id, len(h) // 2 AS size, md5(unhex(h)) AS md5 FROM mrg",
        "path_totals": "SELECT ds AS dataset_id, n_steps, overlap, mismatches, approximate_joins, size AS recovered_size, complete FROM tot",
        "beam_candidates": """SELECT ends.ds AS dataset_id, place AS rank, done AS complete, len(pth) AS n_steps, ov AS overlap, miss AS mismatches, app AS approximate_joins, array_to_string(pth, ',') AS pa_th, array_to_string(ovs, ',') AS overlaps,
            grew AS states_expanded, made AS states_generated, wide AS maximum_beam_size, count(*) FILTER (done) OVER (PARTITION BY ends.ds) AS complete_candidates FROM ends JOIN tally ON tally.ds = ends.ds QUALIFY place <= 3""",
        "beam_output": """SELECT ds AS dataset_id, len(h) // 2 AS size, md5(unhex(h)) AS md5 FROM (
            SELECT x.ds, string_agg(substr(nd.h, 2 * x.o + 1), '' ORDER BY k) AS h FROM (SELECT ds, unnest(pth) AS id, unnest(ovs) AS o, unnest(range(len(pth))) AS k FROM ends WHERE place = 1) x JOIN nd ON nd.ds = x.ds AND nd.id = x.id GROUP BY x.ds)""",
        "placements": "SELECT ds AS dataset_id, k AS step_no, id AS node_id, a0 AS start, n AS size FROM pl",
        "consensus_votes": "SELECT ds AS dataset_id, pos AS position, v::SMALLINT AS value, c AS votes FROM vote",
        "consensus_positions": "SELECT ds AS dataset_id, pos AS position, obs AS observations, kinds AS distinct_values, votes, old::SMALLINT AS before, new::SMALLINT AS after, support, kind FROM po WHERE kind <> 'corroborated'",
        "repair_counters": "SELECT mrg.ds AS dataset_id, count(pos) AS redundant, count(*) FILTER (kinds > 1) AS conflicting, count(*) FILTER (kind = 'corroborated') AS corroborated, count(*) FILTER (kind = 'repaired') AS repaired, count(*) FILTER (kind = 'ambiguous') AS ambiguous FROM mrg LEFT JOIN po USING (ds) GROUP BY mrg.ds",
        "repaired_output": "SELECT ds AS dataset_id, len(h) // 2 AS size, md5(unhex(h)) AS md5 FROM rep",
        "repair_report": """SELECT ds AS dataset_id, CASE WHEN kind = 'repaired' THEN kind ELSE 'ambiguous' END AS status, pos AS position, 'consensus' AS stage, printf('%02x', old) AS baseline, CASE WHEN kind = 'repaired' THEN printf('%02x', new) ELSE '-' END AS result,
            CASE WHEN kind = 'repaired' THEN support || '/' || obs || ' votes' ELSE votes END AS evidence, row_number() OVER (PARTITION BY ds ORDER BY kind = 'ambiguous', pos) AS seq FROM po WHERE kind <> 'corroborated'""",
        "damage_drop": f"SELECT ds AS dataset_id, id AS frag_id, row_number() OVER (PARTITION BY ds ORDER BY {_md5(5, 'drop', 'ds', 'id')}, id) = 1 AS dropped FROM sh",
        "damage_roles": "SELECT ds AS dataset_id, id AS frag_id, role, coalesce(source, -1) AS source_frag_id FROM roles",
        "damage_changes": "SELECT ds AS dataset_id, id AS frag_id, b AS byte_offset, old::SMALLINT AS original_value, new::SMALLINT AS corrupted_value FROM chg",
        "damage_fragments": "SELECT ds AS dataset_id, id AS frag_id, off AS offset, h AS data FROM dmg",
        "emission": f"SELECT ds AS dataset_id, id AS frag_id, row_number() OVER (PARTITION BY ds ORDER BY {_md5(3, 'shuffle', 'ds', 'id')}, id) - 1 AS position, 'shard_' || substr({_md5(3, 'name', 'ds', 'id')}, 1, 16) || '.bin' AS filename FROM dmg",
        "recovery_metrics": """SELECT ds AS dataset_id, * EXCLUDE (ds), reconstructed_bytes - original_bytes AS size_delta, genuine - consistent AS inconsistent,
            represented / nullif(surviving, 0) AS recall, selected_noise / nullif(emitted_noise, 0) AS noise_rate, ordered / nullif(comparable, 0) AS order_accuracy FROM met""",
        "recovery_aggregate": "SELECT count(*) AS runs, count(*) FILTER (exact_recovery) AS exact_runs, avg(represented / nullif(surviving, 0)) AS mean_recall, avg(ordered / nullif(comparable, 0)) AS mean_order_accuracy, avg(selected_noise) AS mean_selected_noise FROM met",
        "trace_edges_filtered": """SELECT ds AS dataset_id, src, dst, idx AS index, overlap, matches, mismatches, exact, overlap || ' B · ' || mismatches || CASE WHEN mismatches = 1 THEN ' mismatch' ELSE ' mismatches' END AS label
          FROM te WHERE NOT exact AND NOT EXISTS (SELECT 1 FROM stp0 WHERE stp0.ds = te.ds AND stp0.prev = te.src AND stp0.id = te.dst)""",
        "path_edges": "SELECT ds AS dataset_id, src, dst, idx AS index, overlap, matches, mismatches, exact, ji AS join_index FROM pe",
        "join_index": "SELECT te.ds AS dataset_id, te.idx AS index, te.src, te.dst, coalesce(pe.ji, -1) AS join_index FROM te LEFT JOIN pe ON pe.ds = te.ds AND pe.src = te.src AND pe.dst = te.dst",
        "adjacent_joins": """SELECT ds AS dataset_id, ji AS join_index, src, dst, coalesce(max(CASE WHEN mismatches > 0 THEN ji END) OVER (PARTITION BY ds ORDER BY ji ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS previous,
            coalesce(min(CASE WHEN mismatches > 0 THEN ji END) OVER (PARTITION BY ds ORDER BY ji ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next FROM pe""",
        "timeline": """SELECT ds AS dataset_id, kind, label, detail, coalesce(ei, -1) AS edge_index, coalesce(ri, -1) AS repair_index, row_number() OVER (PARTITION BY ds ORDER BY ph, i) - 1 AS seq FROM (
            SELECT ds, 0 AS ph, 0::BIGINT AS i, 'graph' AS kind, 'Graph built' AS label, count(*) || ' fragments · ' || (SELECT count(*) FROM e WHERE e.ds = nd.ds) || ' edges' AS detail, NULL::BIGINT AS ei, NULL::BIGINT AS ri FROM nd GROUP BY ds
            UNION ALL SELECT ds, 1, 0, 'path', 'Path selected', n_steps || ' fragments · ' || CASE WHEN complete THEN 'Complete' ELSE 'Incomplete' END, NULL, NULL FROM tot
            UNION ALL SELECT ds, 2, ji, 'join', 'JOIN ' || CASE WHEN ji < 9 THEN '0' ELSE '' END || (ji + 1) || ' · F' || src || ' → F' || dst, overlap || ' B · ' || CASE WHEN exact THEN 'Exact' ELSE 'Approximate · ' || mismatches || ' mismatches' END, ji, NULL FROM pe
            UNION ALL SELECT ds, 3, i, 'repair', 'Consensus repair', 'Offset 0x' || printf('%X', pos) || ' · ' || old || ' → ' || new, NULL, i FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY pos) - 1 AS i FROM po WHERE kind = 'repaired'))""",
        "layout": """SELECT ds AS dataset_id, id AS node_id, CASE WHEN a0 IS NULL THEN 120 + (k % 3) * 220 ELSE 80 + a0 * 230 END::BIGINT AS x, CASE WHEN a0 IS NULL THEN 210 + (k // 3) * 130 ELSE 70 END::BIGINT AS y
          FROM (SELECT nd.ds, nd.id, stp0.k AS a0, sum((stp0.k IS NULL)::INTEGER) OVER (PARTITION BY nd.ds ORDER BY nd.id)::BIGINT - 1 AS k FROM nd LEFT JOIN stp0 ON stp0.ds = nd.ds AND stp0.id = nd.id)""",
        "inspector": "SELECT deg.ds AS dataset_id, deg.id AS node_id, coalesce(stp0.k, -1) AS path_position, ic AS incoming, oc AS outgoing FROM deg LEFT JOIN stp0 ON stp0.ds = deg.ds AND stp0.id = deg.id",
        "trace_mismatches": """SELECT ds AS dataset_id, row_number() OVER (PARTITION BY ds ORDER BY ji, i) - 1 AS seq, src, dst, '0x' || printf('%04X', i) AS "offset", '0x' || substr(lh, 2 * (ln - overlap + i) + 1, 2) AS "left", '0x' || substr(rh, 2 * i + 1, 2) AS "right"
          FROM (SELECT pe.ds, pe.ji, pe.src, pe.dst, pe.overlap, unnest(pe.bad) AS i, l.h AS lh, l.n AS ln, r.h AS rh FROM pe JOIN nd l ON l.ds = pe.ds AND l.id = pe.src JOIN nd r ON r.ds = pe.ds AND r.id = pe.dst)""",
        "trace_summary": """SELECT tot.ds AS dataset_id, NULL::VARCHAR AS error, (SELECT count(*) FROM nd WHERE nd.ds = tot.ds)::INTEGER AS fragments, (SELECT count(*) FROM e WHERE e.ds = tot.ds)::INTEGER AS edges, n_steps::INTEGER AS path,
            (SELECT coalesce(sum(len(bad)), 0) FROM pe WHERE pe.ds = tot.ds)::INTEGER AS mismatches, (SELECT count(*) FROM po WHERE po.ds = tot.ds AND kind = 'repaired')::INTEGER AS repairs, (SELECT count(*) FROM po WHERE po.ds = tot.ds AND kind = 'ambiguous') AS unresolved,
            'greedy' AS strategy, complete, n_steps AS fragments_used, (SELECT count(*) FROM nd WHERE nd.ds = tot.ds) AS fragments_total, size AS output_bytes, approximate_joins, tot.mismatches AS overlap_mismatches, 'exhaustive' AS graph_strategy FROM tot""",
    }


_CLEAN = "/*clean*/"


def _clean_edges(select: str) -> str:
    """Marks a query that also needs the edges of clean shards."""
    return _CLEAN + select


_CE = f"""ce AS MATERIALIZED (SELECT l.ds, l.id AS src, r.id AS dst, max(l.n - l.p) AS n FROM (
    SELECT ds, id, h, n, p, substr(h, 2 * p + 1, {2 * _M}) AS g FROM (SELECT ds, id, h, len(h) // 2 AS n, unnest(range(len(h) // 2 - {_M} + 1)) AS p FROM sh WHERE len(h) // 2 >= {_M})) l
  JOIN (SELECT ds, id, h, substr(h, 1, {2 * _M}) AS g FROM sh WHERE len(h) // 2 >= {_M}) r ON l.ds = r.ds AND l.g = r.g AND l.id <> r.id
  WHERE starts_with(r.h, substr(l.h, 2 * l.p + 1)) GROUP BY ALL)"""


def _png() -> dict[str, str]:
    """The synthetic files again, and a walk over their chunks by recursion."""
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[i] = c
    crc = lambda h: f"xor(4294967295::BIGINT, list_reduce(list_transform(range(len({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(tab.t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT))"
    code = {c: i for i, c in enumerate(png.CODES)}
    piece = sc.PIECE
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    issue = lambda name, where, a0, cond, k: f"SELECT ds, {a0} AS step, {k} AS k, '{name}' AS code, {where} AS off FROM ch WHERE {cond}"
    parts = f"""
tab AS MATERIALIZED (SELECT {table}::BIGINT[] AS t),
raw AS (SELECT ds, 0 AS o, 2 AS i, 'IHDR' AS tag, printf('%08X', ds % 50) || printf('%08X', 1 + ds % 7) || '08' || printf('%02X', [0, 2, 3, 4, 6, 5][ds % 6 + 1]) || CASE WHEN ds % 11 = 0 THEN '01' ELSE '00' END || '00' || printf('%02X', ds % 4) AS body FROM src
  UNION ALL SELECT ds, 10 + 2 * p, p + 1, 'IDAT', substr(h, {2 * piece} * p + 1, {2 * piece}) FROM (SELECT ds, h, unnest(range(ceil(len(h) / {2.0 * piece})::BIGINT)) AS p FROM src)
  UNION ALL SELECT ds, 11, 0, 'tEXt', '6162' FROM src WHERE ds % 3 = 0 AND len(h) > 0
  UNION ALL SELECT ds, 2000000000, 3, 'IEND', '' FROM src),
rc AS (SELECT ds, o, printf('%08X', len(body) // 2) || hex(tag) || body || printf('%08X', CASE WHEN (ds + i) % 13 = 0 THEN xor(crc, 1) ELSE crc END) AS h FROM (
  SELECT raw.*, {crc("cov")} AS crc FROM (SELECT *, hex(tag) || body AS cov FROM raw) raw, tab)),
png0 AS (SELECT ds, '89504E470D0A1A0A' || string_agg(h, '' ORDER BY o) || CASE WHEN ds % 17 = 0 THEN '00' ELSE '' END AS h FROM rc GROUP BY ds),
png AS MATERIALIZED (SELECT ds, CASE WHEN ds % 19 = 0 THEN substr(h, 1, len(h) - 14) ELSE h END AS h FROM png0),
st AS (SELECT ds, 8::BIGINT AS a0, 0 AS step, ''::VARCHAR AS tag, 0::BIGINT AS len, '' AS stop FROM png WHERE starts_with(h, '89504E470D0A1A0A')
  UNION ALL SELECT ds, CASE WHEN stop = '' THEN a0 + 12 + len ELSE a0 END, step, tag, len, CASE WHEN stop = '' AND tag = '49454E44' THEN 'end' ELSE stop END FROM (
    SELECT st.ds, st.a0, st.step + 1 AS step, substr(png.h, 2 * st.a0 + 9, 8) AS tag, CASE WHEN len(png.h) // 2 - st.a0 >= 8 THEN ('0x' || substr(png.h, 2 * st.a0 + 1, 8))::BIGINT ELSE 0 END AS len,
      CASE WHEN len(png.h) // 2 - st.a0 < 8 THEN 'header' WHEN st.a0 + 12 + ('0x' || substr(png.h, 2 * st.a0 + 1, 8))::BIGINT > len(png.h) // 2 THEN 'chunk' ELSE '' END AS stop
    FROM st JOIN png USING (ds) WHERE st.stop = '' AND st.a0 < len(png.h) // 2)),
ch0 AS (SELECT st.ds, st.step, st.a0 - 12 - st.len AS off, st.len, st.tag, ('0x' || substr(png.h, 2 * (st.a0 - 4) + 1, 8))::BIGINT AS stored, substr(png.h, 2 * (st.a0 - 8 - st.len) + 1, 2 * (st.len + 4)) AS cov, len(png.h) // 2 AS n, st.a0 AS nxt
  FROM st JOIN png USING (ds) WHERE st.step > 0 AND st.stop IN ('', 'end')),
ch AS MATERIALIZED (SELECT ch0.*, {crc("cov")} AS computed, substr(cov, 9) AS b, ch0.stored = {crc("cov")} AS ok, decode(unhex(tag)) AS name,
  count(*) FILTER (tag = '49484452') OVER w AS n_ihdr, bool_or(tag = '49444154') OVER w AS saw FROM ch0, tab WINDOW w AS (PARTITION BY ds ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
brk AS (SELECT c.ds, c.step, EXISTS (SELECT 1 FROM ch x WHERE x.ds = c.ds AND x.step < c.step AND x.name <> 'IDAT' AND x.saw) AS gone FROM ch c WHERE name = 'IDAT'),
u8 AS (SELECT ds, step, ('0x' || substr(b, 1, 8))::BIGINT AS width, ('0x' || substr(b, 9, 8))::BIGINT AS height, ('0x' || substr(b, 17, 2))::SMALLINT AS bit_depth, ('0x' || substr(b, 19, 2))::SMALLINT AS color_type,
  ('0x' || substr(b, 21, 2))::SMALLINT AS compression_method, ('0x' || substr(b, 23, 2))::SMALLINT AS filter_method, ('0x' || substr(b, 25, 2))::SMALLINT AS interlace_method FROM ch WHERE name = 'IHDR' AND len = 13),
iss0 AS (
  {issue("crc_mismatch", "off", "step", "NOT ok", 2)}
  UNION ALL {issue("ihdr_not_first", "off", "step", "step = 1 AND name <> 'IHDR'", 3)}
  UNION ALL {issue("duplicate_ihdr", "off", "step", "name = 'IHDR' AND n_ihdr > 0", 4)}
  UNION ALL {issue("invalid_ihdr_length", "off", "step", "name = 'IHDR' AND len <> 13", 5)}
  UNION ALL {issue("invalid_iend_length", "off", "step", "name = 'IEND' AND len <> 0", 12)}
  UNION ALL {issue("trailing_data", "nxt", "step", "name = 'IEND' AND nxt <> n", 13)}
  UNION ALL SELECT ch.ds, ch.step, x.k, x.code, ch.off FROM ch JOIN u8 USING (ds, step), LATERAL (VALUES
    (6, 'invalid_dimensions', width = 0 OR height = 0), (7, 'invalid_compression_method', compression_method <> 0), (8, 'invalid_filter_method', filter_method <> 0), (9, 'invalid_interlace_method', interlace_method > 1),
    (10, 'invalid_color_type_bit_depth', NOT ((color_type = 0 AND bit_depth IN (1, 2, 4, 8, 16)) OR (color_type = 3 AND bit_depth IN (1, 2, 4, 8)) OR (color_type IN (2, 4, 6) AND bit_depth IN (8, 16))))) x(k, code, bad) WHERE x.bad
  UNION ALL SELECT ch.ds, ch.step, 11, 'nonconsecutive_idat', ch.off FROM ch JOIN brk USING (ds, step) WHERE gone
  UNION ALL SELECT ds, step, 0, 'truncated_chunk_header', a0 FROM st WHERE stop = 'header'
  UNION ALL SELECT ds, step, 1, 'truncated_chunk', a0 FROM st WHERE stop = 'chunk'
  UNION ALL SELECT ds, 1000000000, 0, 'missing_ihdr', 8 FROM png WHERE ds NOT IN (SELECT ds FROM ch WHERE name = 'IHDR')
  UNION ALL SELECT ds, 1000000000, 1, 'missing_idat', 8 FROM png WHERE ds NOT IN (SELECT ds FROM ch WHERE name = 'IDAT')
  UNION ALL SELECT ds, 1000000000, 2, 'missing_iend', len(h) // 2 FROM png WHERE ds NOT IN (SELECT ds FROM ch WHERE name = 'IEND')),
names(code, ord, msg) AS (VALUES {', '.join(f"({quote(c)}, {i}, {quote(png.MESSAGES.get(c, ''))})" for c, i in code.items())}),
iss AS MATERIALIZED (SELECT ds, row_number() OVER (PARTITION BY ds ORDER BY step, k) - 1 AS seq, code, ord, off, msg FROM iss0 JOIN names USING (code)),
cnt AS (SELECT ds, count(*) AS n, count(*) FILTER (ok) AS good, bool_or(name = 'IDAT') AS idat, bool_or(name = 'IEND') AS iend FROM ch GROUP BY ds),
flag AS (SELECT ds, bool_or(code LIKE 'truncated%') AS cut, bool_or(ord <= {png.STRUCTURAL}) AS bad, bool_or(code IN ({', '.join(map(quote, sorted(png.SEMANTIC)))})) AS sem, bool_or(code IN ('invalid_ihdr_length', 'invalid_dimensions')) AS dim FROM iss GROUP BY ds),
summ AS (SELECT png.ds, NOT coalesce(cut, false) AS done, NOT coalesce(bad, false) AS str, NOT coalesce(bad, false) AND NOT coalesce(sem, false) AS sem, coalesce(n, 0) > 0 AND coalesce(n, 0) = coalesce(good, 0) AS all_ok,
  coalesce(good, 0) AS good, coalesce(n, 0) - coalesce(good, 0) AS wrong, coalesce(n, 0) AS n, coalesce(idat, false) AS idat, coalesce(iend, false) AS iend, u8.width IS NOT NULL AND NOT coalesce(dim, false) AS head, u8.* EXCLUDE (ds, step)
  FROM png LEFT JOIN cnt USING (ds) LEFT JOIN flag USING (ds) LEFT JOIN u8 USING (ds))"""
    # the files with two bytes changed, as if votes had tied: walked, tried by checksum, repaired and walked again
    at, to = parts.index("st AS ("), parts.index("brk AS (")
    files, walk = parts[:at].replace("png AS MATERIALIZED", "whole AS MATERIALIZED"), parts[at:to]
    again = re.sub(r"\b(st|ch0|ch|png)\b", r"\1_after", walk)
    draw = lambda purpose: _draw(11, purpose, "ds", "j")
    spliced = lambda h, at, v: f"substr({h}, 1, 2 * ({at})) || printf('%02X', {v}) || substr({h}, 2 * ({at}) + 3)"
    reason = {n: quote(getattr(png, n)) for n in ("NO_MATCH", "MATCHES", "SEVERAL", "OUTSIDE")}
    tied = f"""{files}
hit AS MATERIALIZED (SELECT ds, j, pos, old, xor(old, 1 + {draw("corrupt-value")} % 255) AS new FROM (
  SELECT ds, j, pos, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT AS old FROM (
    SELECT ds, h, j, (j * t) // 2 + {draw("corrupt")} % (((j + 1) * t) // 2 - (j * t) // 2) AS pos FROM (SELECT ds, h, (len(h) // 2)::BIGINT AS t, unnest(range(2)) AS j FROM whole)))),
half AS (SELECT whole.ds, {spliced("whole.h", "hit.pos", "hit.new")} AS h FROM whole JOIN hit ON hit.ds = whole.ds AND hit.j = 0),
png AS MATERIALIZED (SELECT half.ds, {spliced("half.h", "hit.pos", "hit.new")} AS h FROM half JOIN hit ON hit.ds = half.ds AND hit.j = 1),
{walk}
met AS (SELECT hit.ds, hit.pos, hit.old, hit.new, ch.off, ch.cov, ch.stored, count(ch.off) OVER (PARTITION BY hit.ds, ch.off) AS n
  FROM hit LEFT JOIN ch ON ch.ds = hit.ds AND hit.pos >= ch.off + 4 AND hit.pos < ch.off + 8 + ch.len),
tries AS (SELECT ds, pos, v, {crc("cov")} = stored AS good FROM (SELECT ds, pos, v, stored, {spliced("cov", "pos - off - 4", "v")} AS cov FROM (SELECT *, unnest([old, new]) AS v FROM met WHERE n = 1)) z, tab),
ok AS (SELECT ds, pos, count(*) FILTER (good) AS hits, max(v) FILTER (good) AS v FROM tries GROUP BY ds, pos),
fate AS MATERIALIZED (SELECT met.ds, met.pos, met.off, met.new, met.stored, met.n, hits, CASE WHEN hits = 1 THEN v END AS aft,
  CASE WHEN met.off IS NULL THEN {reason["OUTSIDE"]} WHEN met.n > 1 THEN {reason["SEVERAL"]} WHEN hits = 0 THEN {reason["NO_MATCH"]} WHEN hits > 1 THEN {reason["MATCHES"]} ELSE '' END AS why
  FROM met LEFT JOIN ok ON ok.ds = met.ds AND ok.pos = met.pos)"""
    after = f""",
one AS (SELECT ds, min(pos) AS p, arg_min(aft, pos) AS v, max(pos) AS q, arg_max(aft, pos) AS w, count(*) AS k FROM fate WHERE aft IS NOT NULL GROUP BY ds),
png_after AS MATERIALIZED (SELECT png.ds, CASE WHEN p IS NULL THEN h WHEN k = 1 THEN {spliced("h", "p", "v")} ELSE substr(h, 1, 2 * p) || printf('%02X', v) || substr(h, 2 * p + 3, 2 * (q - p - 1)) || printf('%02X', w) || substr(h, 2 * q + 3) END AS h FROM png LEFT JOIN one ON one.ds = png.ds),
{again.rstrip().rstrip(",")}"""
    source = f"src AS ({_PARTS['src']})"
    head = f"WITH RECURSIVE {source}, {parts} "
    word = lambda c: f"CASE WHEN {c} THEN 'valid' ELSE 'invalid' END"
    there = lambda c: f"CASE WHEN {c} THEN 'present' ELSE 'missing' END"
    ahead = f"WITH RECURSIVE {source}, {tied}"
    state = lambda t, k: f"SELECT ds, count(*) FILTER (ok) AS valid_{k}, count(*) FILTER (NOT ok) AS invalid_{k} FROM {t} GROUP BY ds"
    zero = lambda *c: ", ".join(f"coalesce({x}, 0) AS {x}" for x in c)
    return {
        "crc_repairs": ahead + """ SELECT ds AS dataset_id, pos AS position, coalesce(off, -1) AS c_at, CASE WHEN n = 1 THEN new ELSE -1 END::SMALLINT AS before, coalesce(aft, -1)::SMALLINT AS after, CASE WHEN n = 1 THEN 2 ELSE 0 END::BIGINT AS candidates_tested,
            CASE WHEN n = 1 THEN stored ELSE -1 END AS stored_crc, why AS reason, coalesce(aft <> new, false) AS changed, CASE WHEN aft IS NULL THEN 'unresolved' WHEN aft <> new THEN 'repaired' ELSE 'corroborated' END AS kind FROM fate""",
        "crc_summary": ahead + after + f""" SELECT png.ds AS dataset_id, {zero("valid_before", "invalid_before", "valid_after", "invalid_after", "eligible_ambiguous_bytes", "chunks_evaluated", "unresolved")}
            FROM png LEFT JOIN ({state("ch", "before")}) b ON b.ds = png.ds LEFT JOIN ({state("ch_after", "after")}) a ON a.ds = png.ds
            LEFT JOIN (SELECT ds, count(off) AS eligible_ambiguous_bytes, count(*) FILTER (n = 1) AS chunks_evaluated, count(*) FILTER (aft IS NULL) AS unresolved FROM fate GROUP BY ds) f ON f.ds = png.ds""",
        "png_chunks": head + "SELECT ds AS dataset_id, (step - 1)::INTEGER AS idx, off AS offset, len AS length, name AS type, stored AS stored_crc, computed AS computed_crc, ok AS crc_valid FROM ch",
        "png_issues": head + "SELECT ds AS dataset_id, seq::INTEGER AS seq, code, ord::INTEGER AS code_ord, off AS offset, msg AS message FROM iss",
        "png_summary": head + """SELECT ds AS dataset_id, true AS signature_valid, done AS parsing_completed, str AS structurally_valid, sem AS semantically_valid, all_ok AS all_crcs_valid, good AS valid_crc_count, wrong AS invalid_crc_count, n::INTEGER AS chunks,
            width, height, bit_depth, color_type, compression_method, filter_method, interlace_method FROM summ""",
        "png_evidence": head + f"""SELECT ds AS dataset_id, array_to_string([str::INTEGER, all_ok::INTEGER, -wrong, sem::INTEGER, 1, head::INTEGER, idat::INTEGER, iend::INTEGER, n], ',') AS ranking_keys,
            'PNG signature=valid; PNG structure=' || {word("str")} || '; PNG semantics=' || {word("sem")} || '; PNG IHDR=' || {word("head")} || '; PNG IDAT=' || {there("idat")} || '; PNG IEND=' || {there("iend")}
            || '; PNG chunks=' || n || '; CRC=' || good || ' / ' || n || ' valid; CRC failures=' || wrong AS facts FROM summ""",
    }


def all_oracles() -> dict[str, str]:
    """SQL by query name."""
    clean = f"WITH src AS ({_PARTS['src']}), sh AS MATERIALIZED ({_PARTS['sh']}), {_CE} "
    out = {n: clean + s.removeprefix(_CLEAN) if s.startswith(_CLEAN) else _with(s) for n, s in _scenario().items()}
    return {n: q.replace("pa_th", "path") for n, q in (out | _png()).items()}
