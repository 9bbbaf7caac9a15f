"""Divergence rules, page extraction, tool calls and the pipeline."""

import functools
import importlib
import json
import math
import random
import re
import time
from collections import Counter

import duckdb
import pytest

from fragweave.llm import divergence, oracles, queries, styletree, toolcalls
from tests.llm import samples


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_divergence(spark):
    data = samples.rows(120)
    data += [[5000, "a b c d e f\nx\na b c d e f\nx\n \nq", "en"], [5001, "one two three four five six seven " * 4, "fr"], [5002, " ".join(f"{w}%%%" for w in data[0][1].split() * 3), "en"]]
    data += samples.ODD
    rows = divergence.judge(samples.table(spark, data)).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((i, *brute_counts(t)) for i, t, _ in data)
    by = {r.doc_id: r for r in rows}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert by[5002].chars_distance > 0.2 and not by[5002].kept
    clean = [r for r in rows if r.doc_id < 120]
    assert sum(r.kept for r in clean) > 0.9 * len(clean)
    assert not any(r.kept for r in rows if r.base_failed)
    assert divergence.judge(samples.empty(spark)).count() == 0
    # the DuckDB form of the query, on the same rows
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r for r in data if r[0] != 9008])
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, base_failed, kept FROM ({oracles.op1()})").fetchall()}
    alone = divergence.judge(samples.table(spark, [r for r in data if r[0] != 9008])).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in alone} == want


PAGES = {
    "": "",
    "plain text  a\n b": "plain text a b",
    "<p>a<p>b<p>": "a\n\nb",
    "<article><h1>T</h1><div class='share'>no</div><p>x &lt;b&gt; y<br>z</p><aside>no</aside><section id='comments'><p>no</p></section></article><footer>f</footer>": "T\n\nx <b> y z",
    "<nav>n</nav><main><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main>out": "one\n\ntwo\n\na b",
    "a < b and c <": "a < b and c <",
    "<p>cut <a href='x": "cut",
    "<script>if (a<b) {</script><style>p</style><p>ok</p>": "ok",
    "<p>&#8364;&nbsp;&eacute;</p>": "€ é",
    "<header>h</header><article><header><h1>H</h1></header><p>t</p></article>": "H\n\nt",
    "<p>x<!-- <p>no</p> -->y</p><form>f</form><div hidden>h</div><div role=navigation>r</div>": "xy",
    "<p><b>bold.<br><p>next</b> on": "bold.\n\nnext on",
}


def test_pages():
    for page, text in PAGES.items():
        assert styletree.main_text(styletree.parse(page)) == text, page
    deep = styletree.parse("<div>" * 30000 + "deep")
    assert styletree.main_text(deep) == "deep" and len(styletree.annotate(deep)) == 30001


def test_letters_that_grow_in_lower_case():
    assert styletree.main_text(styletree.parse("<title>" + "İ" * 8 + "</title><p>text</p>")) == "text"
    assert styletree.main_text(styletree.parse("İ" * 40 + "<script>x</script><p>next</p><SCRIPT>y</ſcript></SCRIPT>z")) == "İ" * 40 + "\n\nnext\n\nz"


def test_time_is_in_proportion_to_the_page():
    took = []
    for n in (20_000, 200_000):
        begun = time.time()
        for page in ("<span>" * n + "</p>" * n, "<b><div>" + "<span>" * n + "</b>" * n + "x", "<li>" * n, "<td>" * n + "<p>" * n, "<script>" * n, "<a " * n):
            styletree.main_text(styletree.parse(page))
        took.append(time.time() - begun)
    assert took[1] < 25 * max(took[0], 0.2)


def test_article_is_no_selector_where_it_holds_a_teaser():
    body = "word " * 200
    assert styletree.main_text(styletree.parse(f"<div><p>{body}</p></div><article><p>read on</p></article>")) == f"{body.strip()}\n\nread on"
    assert styletree.main_text(styletree.parse(f"<div><p>teaser</p></div><article><p>{body}</p></article>")) == body.strip()


def brute_trees(pages):
    """Importance of every presentation node and the common contents, from first principles: a dictionary of distinct pages."""
    hosts, out, common = {}, {}, set()
    for url, html in pages:
        root = styletree.parse(html)
        text = re.sub(r"<[^<>]*>", "", " ".join(re.split(r"(?i)</?(?:script|style)\b", html)[::2]))
        hosts.setdefault(styletree.host_of(url), {})[text] = styletree.annotate(root)
    for host, by in hosts.items():
        paths = {n.path for order in by.values() for n in order}
        for p in paths:
            own = [[n for n in order if n.path == p and n.content] for order in by.values()]
            m = sum(any(n.path == p for n in order) for order in by.values())
            shapes = Counter(tuple(c.sign for c in n.children if isinstance(c, styletree.Node)) for page in own for n in page)
            held = Counter(x for page in own for x in {x for n in page for x in styletree.features(n)})
            said = Counter(x for page in own for x in {n.content for n in page if styletree.judged(n)})
            common |= {(host, p, x) for x, d in said.items() if d >= styletree.MIN_SUPPORT and 2 * d > len(by)}
            if held:
                o = sum(shapes.values())
                entropy = sum(-c / o * math.log(c / o) for c in shapes.values()) / math.log(o) if o > 1 else 1.0
                rest = sum(1 - math.log(d) / math.log(m) for d in held.values()) / len(held) if m > 1 else 1.0
                out[host, p] = styletree.PRESENTATION * entropy + (1 - styletree.PRESENTATION) * rest
    return out, common


SITE = "<body><div><a href=/home>Home</a> <a href=/about>About us</a></div><div>{0}. Unlike others, {1}.</div><div>We use cookies here.</div><ul><li>Terms</li><li>Help {2}</li></ul><script>n({0})</script></body>"


def site_pages(n=60):
    data = [(i, f"http://site.org/{i}", SITE.format(f"Story {i} tells of {i * 31 % 97}", f"it has {i * 7} words and <b>bold</b> ones", i % 3)) for i in range(n)]
    data += [(1000 + i, f"http://site.org/copy{i}", data[0][2].replace("n(", f"n({i}")) for i in range(n)]
    return data + [(2000 + i, f"http://few.org/{i}", SITE.format("A", "b", i)) for i in range(3)]


def test_importance_against_brute_force(spark):
    data = site_pages()
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    nodes, common = styletree.trees(pages)
    want, often = brute_trees([r[1:] for r in data])
    got = {(r.host, r.path): r.importance for r in nodes.collect() if r.importance is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert {(r.host, r.path, r.x % (1 << 64)) for r in common.collect()} == often and often


def test_importance_removes_unmarked_menus_and_notices(spark):
    """No class, role or element says what is a menu, a notice or a list of links; the site's pages do."""
    data = site_pages()
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in styletree.extract(pages).collect()}
    for i in [*range(60), *range(1000, 1060)]:
        k = i if i < 1000 else 0
        assert got[i] == f"Story {k} tells of {k * 31 % 97}. Unlike others, it has {k * 7} words and bold ones."
    assert all("cookies" in got[2000 + i] for i in range(3))


def test_marks_off_importance_still_finds_menus_of_the_tables(spark, monkeypatch):
    """With no mark and no article read, importance alone removes most of what isn't the article on a host of many pages."""
    path = "/root/testdata/sf0.1/pages.parquet"
    pages = spark.read.parquet(path).where("url like '%//blog.tionsh.example.com/%'")
    full = {r.page_id: r.text for r in styletree.extract(pages).collect()}
    nodes, _ = styletree.trees(pages)
    limit = styletree.sites(pages).first().limit
    low = {r.path for r in nodes.where(f"importance < {limit}").collect()}
    path_of = lambda *signs: functools.reduce(styletree.below, signs, 0)
    assert {path_of("html", "body", "nav", "ul", "li", "a"), path_of("html", "body", "div.ad"), path_of("html", "body", "footer")} <= low
    assert not {path_of("html", "body", "article", *x) for x in (("p",), ("h1",), ("p", "b"))} & low
    monkeypatch.setattr(styletree.Node, "marked", lambda self: self.tag in ("head", "script", "style"))
    sites = {r.host: styletree._site(r.path, r.importance, r.common, r.limit) for r in styletree.sites(pages).collect()}
    bare = {r.page_id: styletree.main_text(styletree.parse(re.sub(r"(?i)</?article>", "", r.html)), None) for r in pages.collect()}
    cut = {r.page_id: styletree.main_text(styletree.parse(r.html), sites["blog.tionsh.example.com"]) for r in pages.collect()}
    assert len(bare) > 200 and cut == full and sum(map(len, bare.values())) > sum(map(len, full.values()))


def test_site_statistics(spark):
    page = "<html><body><div class=x><p>Same box</p></div><div><p>text {0}</p><p>more {1}</p></div></body></html>"
    data = [(i, f"http://a.b/{i}", page.format(i, i * 7)) for i in range(40)]
    data += [(50, None, page.format(1, 1)), (51, "http://a.b/", None), (52, "http://c.d/", ""), (53, "http://c.d/x", page.format(2, 2)), (0, "http://a.b/0", page.format(0, 0))]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in data], "page_id long, url string, html string, noise string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in styletree.extract(pages).collect()]
    want = [(i, f"text {i}\n\nmore {i * 7}") for i in [*range(40), 0]] + [(50, "Same box\n\ntext 1\n\nmore 1"), (51, ""), (52, ""), (53, "Same box\n\ntext 2\n\nmore 2")]
    assert sorted(got) == sorted((i, t, len(t)) for i, t in want)
    assert styletree.extract(pages.limit(0)).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    page = "<body><div class=x><p>Same box</p></div><p>text {0}</p></body>"
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", page.format(i)) for i in range(20)], "page_id long, url string, html string")
    one = sorted(map(tuple, styletree.extract(pages).collect()))
    monkeypatch.setattr(styletree, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, styletree.extract(pages).collect())) == one and one[0][2] == "text 0"


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def linked(spark, rows, **kw):
    return toolcalls.link(toolcalls.read_events(talk(spark, rows)), **kw).collect()


@pytest.mark.parametrize("one_task", [100_000, 1])
def test_tool_calls(spark, one_task):
    schema = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}
    calls = [{"id": "b", "name": "f", "arguments": {"x": {"$ref": "a"}}}, {"id": "a", "name": "f", "arguments": {"x": 3.0}}, {"id": "c", "function": {"name": "f", "arguments": '{"x": "s"}'}}, {"id": "p", "name": "f", "arguments": {"x": {"$ref": "q"}}}, {"id": "q", "name": "g", "arguments": {"x": {"$ref": "p"}}}, {"id": "d", "name": "f", "arguments": {"x": {"$ref": "b"}}}]
    rows = [
        (1, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": schema}]})),
        (1, 1, "assistant", json.dumps({"tool_calls": calls})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": [1.5]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": None})),
        (1, 4, "assistant", 'text <tool_call>{"id": "a", "name": "f", "arguments": {"x": 1}}</tool_call>'),
        (1, 5, "assistant", '{"tool_calls": [{"name": "f"}]}'),
        (2, 2, "tool", json.dumps({"tool_call_id": "a", "content": 1})),
        (2, 0, "user", None),
        (None, None, None, "{"),
        (3, 0, "assistant", "<tool_call>{bad</tool_call>"),
        (3, 1, "user", json.dumps({"tool_calls": calls})),
    ]
    got = {(r.conv_id, r.turn, r.idx): r for r in linked(spark, rows, one_task=one_task)}
    assert len(got) == 15 and not any(r.kind == "tool" for r in got.values())
    a, b = got[1, 1, 1], got[1, 1, 0]
    assert (a.level, a.status, a.valid, a.n_calls, a.n_results) == (0, "linked", True, 2, 1)
    assert a.json == '{"result":{"a":[1.5],"z":1},"role":"assistant","tool_call":{"arguments":{"x":3},"id":"a","name":"f"}}'
    assert (b.level, b.status, b.valid) == (1, "no_result", True) and got[1, 1, 5].level == 2
    assert (got[1, 1, 2].valid, got[1, 1, 2].errors) == (False, ["$.x: not integer"])
    assert got[1, 1, 3].level == got[1, 1, 4].level == -1 and got[1, 1, 4].errors == ["unknown tool"]
    assert (got[1, 3, 0].status, got[1, 3, 0].level) == ("no_call", None) and got[2, 2, 0].status == "no_call"
    assert (got[1, 4, 0].status, got[1, 5, 0].status) == ("linked", "no_id")
    assert (got[3, 0, 0].status, got[3, 0, 0].valid, got[3, 0, 0].json) == ("malformed", False, '{"content":"{bad","role":"assistant"}')
    assert (got[2, 0, 0].status, got[2, 0, 0].json) == ("message", '{"content":null,"role":"user"}')
    assert got[None, None, 0].json == '{"content":"{","role":null}' and got[3, 1, 0].kind == "message"
    assert linked(spark, rows[:0]) == []


def test_malformed_tool_turns(spark):
    """No turn fails the job; each has its row and says what is wrong with it."""
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    faults = {"pattern": "(", "minLength": "x", "maxLength": [], "enum": 5, "required": 7, "type": 3, "properties": 4}
    tools = [{"name": k, "parameters": {"properties": {"v": {k: v}}} if k not in ("required", "properties") else {k: v}} for k, v in faults.items()]
    tools.append({"name": "slow", "parameters": {"properties": {"v": {"pattern": "^(a+)+$"}}}})
    call = lambda name, arguments: f'<tool_call>{{"id": "{name}", "name": "{name}", "arguments": {arguments}}}</tool_call>'
    rows = [(1, 0, "system", json.dumps({"tools": tools}))]
    rows += [(1, 1 + i, "assistant", call(k, '{"v": "abc"}')) for i, k in enumerate(faults)]
    rows += [(1, 20, "assistant", call("slow", json.dumps({"v": "a" * 60 + "!"}))), (1, 21, "assistant", call("inf", "1e999")), (1, 22, "assistant", call("deep", deep)), (1, 23, "assistant", call("half", '{"v": "\\ud800", "\\udfff": {"$ref": "\\ud801"}}'))]
    rows += [(1, 24, "assistant", json.dumps({"id": 3, "tool_calls": [5, {"id": ["x"], "name": 7, "arguments": "{"}]})), (1, 25, "tool", "<tool_result>[1]</tool_result><tool_result>{}</tool_result>"), (1, 26, "assistant", call("nan", "NaN")), (1, 27, "assistant", call("long", "9" * 5000)), (1, 28, "system", '{"tools": {"name": "f"}}'), (1, 29, "assistant", "{" * 100_000)]
    got = {(r.turn, r.idx): r for r in linked(spark, rows)}
    for i, k in enumerate(faults):
        assert (got[1 + i, 0].valid, got[1 + i, 0].status) == (False, "no_result") and f"schema: {k}" in got[1 + i, 0].errors[0], k
    assert got[20, 0].errors in (["$.v: pattern takes too long"], ["$.v: pattern"])
    assert {got[t, 0].status for t in (21, 22, 26, 27)} == {"malformed"}
    assert "\ufffd" in got[23, 0].json and got[23, 0].level == 0
    assert [got[24, i].status for i in (0, 1)] == ["malformed", "no_result"] and got[24, 1].call_id == '["x"]' and got[24, 1].json.count('"{"') == 1
    assert [got[25, i].status for i in (0, 1)] == ["malformed", "no_id"]
    assert got[28, 0].kind == got[29, 0].kind == "message"
    assert all(json.loads(r.json) for r in got.values())


def slow_levels(edges, nodes):
    """Longest chains by relaxing n times; what still grows then hangs on a cycle."""
    level = dict.fromkeys(nodes, 0)
    for _ in range(len(nodes) + 1):
        last = dict(level)
        for a, b in edges:
            level[a] = max(level[a], level[b] + 1)
    bad = {a for a in nodes if level[a] != last[a]}
    while more := {a for a, b in edges if b in bad} - bad:
        bad |= more
    return {a: -1 if a in bad else level[a] for a in nodes}


@pytest.mark.parametrize("one_task", [100_000, 3])
def test_levels_against_brute_force(spark, one_task):
    """Generated conversations with references, chains, cycles, repeated identifiers, unknown ones and results, in one table."""
    rng = random.Random(3)
    rows, want = [(100, 0, "assistant", json.dumps({"tool_calls": [{"id": str(i), "name": "f", "arguments": [{"$ref": str(i - 1)}] if i else {}} for i in range(9)]}))], {(100, str(i)): i for i in range(9)}
    for conv in range(12):
        n = rng.randrange(1, 9)
        nodes, edges = [f"c{i}" for i in range(n)], set()
        for turn, i in enumerate(rng.choices(range(n), k=2 * n)):
            refs = rng.sample([*nodes, "nowhere"], min(n + 1, rng.randrange(3))) if conv % 3 else [f"c{j}" for j in rng.sample(range(i), min(i, 2))]
            edges |= {(nodes[i], r) for r in refs if r != "nowhere"}
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": nodes[i], "name": "f", "arguments": {"x": [{"$ref": r} for r in refs]}}]})))
            rows.append((conv, turn + 50, "tool", json.dumps({"tool_call_id": nodes[i], "content": turn})))
        there = {json.loads(r[3])["tool_calls"][0]["id"] for r in rows if r[0] == conv and r[2] == "assistant"}
        want |= {(conv, k): v for k, v in slow_levels([e for e in edges if set(e) <= there], sorted(there)).items()}
    got = linked(spark, rows, one_task=one_task)
    assert {(r.conv_id, r.call_id): r.level for r in got} == want and -1 in want.values() and max(want.values()) == 8
    assert len(got) == len(rows) + 8
    by = {(r.conv_id, r.call_id): r.n_calls for r in got}
    counts = Counter((c, json.loads(t)["tool_calls"][0]["id"]) for c, _, role, t in rows if role == "assistant" and c < 100)
    assert all(by[k] == n for k, n in counts.items())


def test_long_chain_of_references():
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 30_000)]
    assert toolcalls.kahn(chain[::-1])["c29999"] == 29_999


def test_plain_turns(spark, tmp_path):
    """The query over conversations without tool markup, against its DuckDB form."""
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi \"q\" é\n\t\\"), (1, 2, "assistant", "yes [x] {y}"), (1, 3, "user", ""), (2, 0, "assistant", "first"), (2, 1, "user", None), (1, 2, "assistant", "yes"), (None, None, None, None)]
    talks = talk(spark, rows).selectExpr("*", "'clash' as kind", "1 as idx", "'b' as body", "2 as level")
    talks.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(str(tuple(r)) for r in queries.op6_tool_call_linking(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(str(r) for r in con.execute(oracles.op6()).fetchall()) and len(got) == len(rows)


@pytest.mark.parametrize(
    "value, schema, bad",
    [
        (1, {"type": "string"}, ["$: not string"]),
        (True, {"type": "integer"}, ["$: not integer"]),
        ({"a": 1}, {"type": "object", "additionalProperties": False}, ["$.a: not allowed"]),
        ({"a": [1, "x"]}, {"properties": {"a": {"type": "array", "items": {"type": "number"}}}}, ["$.a[1]: not number"]),
        ("abc", {"enum": ["x"], "maxLength": 2, "pattern": "^b"}, ["$: not in enum", "$: too long", "$: pattern"]),
        (5, {"minimum": 6}, ["$: below minimum"]),
        (None, {"type": ["null", "string"]}, []),
    ],
)
def test_schema(value, schema, bad):
    assert toolcalls.problems(value, schema) == bad


def test_queries_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    data = samples.rows(200)
    junk = [[700 + i, " ".join(w + "%%" for w in t.split()), k] for i, t, k in data[:60]]
    odd = [r for r in samples.ODD if r[0] != 9005]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in data + junk + odd], kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _, _ in data] + [(i, 0, 0) for i, _, _ in junk], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step, left = docs, {}
    for name, f in pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path)).cache()
        assert step.columns == docs.columns
        left[name] = {r.doc_id for r in step.select("doc_id").collect()}
    assert len({i for i in left["quality"] if 700 <= i < 9000}) <= 3
    assert len({i for i in left["quality"] if i < 700}) >= 0.95 * len(data)
    assert left["language"] <= left["quality"] and not {9001, 9002, 9003, 9007} & left["language"]
    texts = {i: t for i, t, _ in data + junk + odd}
    fps = {i: _fingerprint(texts[i]) for i in left["language"]}
    for i in left["language"] - left["near_copies"]:
        assert any(j < i and bin(fps[i] ^ fps[j]).count("1") <= 3 for j in fps if j != i)
    kept = sorted(left["near_copies"])
    assert not any(bin(fps[a] ^ fps[b]).count("1") <= 3 for a in kept for b in kept if a < b)
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == left["near_copies"]


def _fingerprint(text):
    from tests.llm.test_near_copies import slow_fingerprint

    return slow_fingerprint(text)


def test_words_within_sentences_stay(spark):
    page = "<body><article><p><b>Note:</b> text {0} see <a>here</a> now</p></article><div><i>Same</i> box</div></body>"
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", page.format(i)) for i in range(40)], "page_id long, url string, html string")
    assert sorted(r.text for r in styletree.extract(pages).collect()) == sorted(f"Note: text {i} see here now" for i in range(40))


def test_copies_of_a_page_are_no_boilerplate(spark):
    page = "<body><div class=story><blockquote>{0}</blockquote></div></body>"
    data = [(i, f"http://a.b/{i}", page.format("the one story")) for i in range(2000)] + [(3000 + i, f"http://a.b/x{i}", page.format(f"other {i}")) for i in range(12)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in styletree.extract(pages).collect()}
    assert got == {i: "the one story" for i in range(2000)} | {3000 + i: f"other {i}" for i in range(12)}


def test_near_copies_keep_one_row_of_each_group(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    far = [t for _, t, _ in samples.rows(8)]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (7, far[2]), (7, far[3]), (7, far[3]), (5, far[4]), (6, far[4]), (None, far[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {t: _fingerprint(t) for t in far[:5]}
    assert all(bin(fps[a] ^ fps[b]).count("1") > 3 for a in fps for b in fps if a != b)
    got = pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(None, far[0]), (None, far[1]), (7, far[2]), (7, far[3]), (5, far[4])])
