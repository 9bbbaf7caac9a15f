"""Main text of web pages by site style trees.

The element trees of all pages of a host are merged by path: a presentation node is a host and the
tags and classes from the root down; a content node is a presentation node with a block's whole
text. Over the distinct pages of the host a presentation node has a distribution of presentations
(the sequences of its children) and features (sentences and link targets of its own text). Its
importance is the weighted mean of the presentations' entropy, divided by the largest possible,
and of what its features leave of theirs: a feature on d of m pages counts 1 - log d / log m. A
content node on most pages of the host has none. In a page, a branch's importance is the mean over
its own nodes and all below, weighted by their text. Branches of less than a share of the host's
mean importance go, as do those that elements, roles or classes mark as menus, notices, adverts,
forms and the like. What is left decides where the main text is: in the article, if that holds
most of the importance, else in the main element on the same condition, else all over the page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.session import cut_lineage

#: Share of the host's mean importance that a branch needs; factor for those within article or main,
#: which a page itself calls its content; distinct pages that a node needs; weight of presentation.
SHARE, WITHIN, MIN_SUPPORT, PRESENTATION = 0.75, 2.0, 8, 0.2
#: Bytes of site trees that are broadcast at most; beyond it, a salted join. Bytes of page counts likewise.
BROADCAST_BYTES, SALTS = 32 << 20, 32

# HTML's element categories, and words of class, id and role that mark a branch as no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset("head nav footer aside form script style noscript iframe button select option textarea input menu dialog template svg canvas object embed audio video map label fieldset title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
CELLS = frozenset(("td", "th"))
CLOSES_P = BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr", "caption", "li", "dd", "dt", "legend"}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar comment comments disqus reply replies respond "
    "footer masthead nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay "
    "share sharing social related recommended recommendations widget toolbar pagination pager login search alert paywall skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
#: In ASCII, since other letters that fold to these don't end raw text.
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PART = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class Node:
    """An element; text children are strings."""

    __slots__ = ("tag", "attrs", "children", "sign", "path", "content", "own", "chars", "mass", "score")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        name = attrs.get("class") or attrs.get("id") or ""
        self.sign = f"{tag}.{'.'.join(sorted(name.lower().split()))}" if name else tag

    def marked(self) -> bool:
        """Whether the element's kind, role, classes or attributes say that it is no part of an article."""
        if self.tag in DROPPED:
            return True
        a = self.attrs
        if not a:
            return False
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        if a.get("role", "").lower() in ROLES:
            return True
        if self.tag in ("html", "body", "article", "main"):
            return "comment" in _PART.findall(a.get("class", "").lower())
        return not HINTS.isdisjoint(_PART.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))


def parse(html: str) -> Node:
    """A tree of a whole page, however malformed: unclosed and stray tags, cut ends, text anywhere.

    Open elements are found by tag and not by walking down the stack, so the time is in
    proportion to the page whatever its depth.
    """
    root = Node("#root", {})
    stack = [root]
    open_: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag, ascending
    edges: list[int] = []  # places of block elements and table cells
    at, n = 0, len(html)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html_lib.unescape(s) if "&" in s else s)

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag].pop()
        while edges and edges[-1] >= k:
            edges.pop()
        del stack[k:]

    def last(tags) -> int:
        return max((open_[t][-1] for t in tags if open_[t]), default=0)

    for m in iter(lambda: _TAG.search(html, at), None):
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            # an end tag closes the nearest such element, but an inline one doesn't reach over a block's edge
            k = last((tag,))
            if k and (tag in BLOCK or tag in CELLS or not edges or edges[-1] < k):
                close(k)
            continue
        attrs = {a[0].lower(): html_lib.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3].strip(" /\n\t\r\f") else {}
        if tag in CLOSES_P and edges and stack[edges[-1]].tag == "p":
            close(edges[-1])
        if tag in SIBLINGS:
            same, edge = SIBLINGS[tag]
            k = last(same)
            if k and k > last(edge):
                close(k)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            # raw text runs to its end tag, whatever it holds
            end = _RAW_END[tag].search(html, at)
            shut = html.find(">", end.end()) if end else -1
            at = n if shut < 0 else shut + 1
        elif tag not in VOID:
            open_[tag].append(len(stack))
            if tag in BLOCK or tag in CELLS:
                edges.append(len(stack))
            stack.append(node)
        if at >= n:
            break
    cut = _OPEN.search(html, at)  # a tag that the page's end cuts within a quoted value
    text(html[at : cut.start() if cut else n])
    return root


def annotate(root: Node) -> list[Node]:
    """All elements, parents first, with path (the root's is 0), own, the pieces of their own text with single spaces, chars, their
    length, and content, a hash of all text within, 0 without text."""
    h = xxhash.xxh64_intdigest
    root.path, order, todo = 0, [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        for c in node.children:
            if isinstance(c, Node):
                c.path = below(node.path, c.sign)
                todo.append(c)
    for node in reversed(order):
        # from the children's hashes, so that each character is hashed once
        parts, node.own = [], []
        for c in node.children:
            if isinstance(c, str):
                s = " ".join(c.split())
                if s:
                    node.own.append(s)
                    parts.append(h(s))
            elif c.content:
                parts.append(c.content)
        node.chars = sum(map(len, node.own))
        node.content = h(np.array(parts, "<u8").tobytes()) if parts else 0
    return order


def below(path: int, sign: str | int) -> int:
    """Hash of a style path one element longer, or of a path and a content. Signed 64 bits, whatever the depth."""
    x = xxhash.xxh64_intdigest(f"{path}/{sign}")
    return x - (1 << 64) if x >> 63 else x


def features(node: Node) -> set[int]:
    """Hashes of the sentences of an element's own text and of where it links to."""
    out = set()
    for s in node.own:
        out.update(map(xxhash.xxh64_intdigest, _SENTENCE.split(s)))
    if node.attrs and (to := node.attrs.get("href") or node.attrs.get("src")):
        out.add(xxhash.xxh64_intdigest(f"to {to}"))
    return out


def judged(node: Node) -> bool:
    """Whether an element is a branch of a site, and not words within a sentence or the frame of the page."""
    return node.tag not in INLINE and node.tag not in ("#root", "html", "body", "article", "main") and node.tag not in CELLS


@dataclass
class Site:
    """What a host's merged tree says: importance of presentation nodes, content nodes that most pages hold, the least importance that stays."""

    importance: dict[int, float]
    common: frozenset[int]
    limit: float


def main_text(root: Node, site: Site | None = None) -> str:
    """Blocks of the main text in page order, without marked branches and those of low importance; without a site none is low."""
    order = annotate(root)
    for node in reversed(order):
        node.mass = node.chars
        node.score = node.mass * (site.importance.get(node.path, 1.0) if site else 1.0)
        for c in node.children:
            if isinstance(c, Node):
                node.mass += c.mass
                node.score += c.score
        if site and node.content and judged(node) and below(node.path, node.content) in site.common:
            node.score = 0.0

    def kept(node: Node, inside: bool) -> bool:
        if node.tag == "header":
            return inside
        if node.marked():
            return False
        if not site or not node.mass or not judged(node):
            return True
        return node.score * (WITHIN if inside else 1.0) >= site.limit * node.mass

    def walk(tops: list[Node], inside: bool) -> tuple[list[str], float]:
        """(blocks, importance of their text)."""
        blocks: list[str] = []
        held: list[str] = []
        weight = 0.0

        def flush() -> None:
            s = " ".join("".join(held).split())
            if s:
                blocks.append(s)
            held.clear()

        for top in tops:
            todo: list = [(top, inside)]
            while todo:
                item = todo.pop()
                if item is None:
                    flush()
                    continue
                if isinstance(item, str):
                    held.append(item)
                    continue
                node, within = item
                if node is not top and not kept(node, within):
                    continue
                within = within or node.tag in ("article", "main")
                weight += node.chars * (site.importance.get(node.path, 1.0) if site else 1.0)
                if node.tag in BLOCK:
                    flush()
                    todo.append(None)
                elif node.tag == "br" or node.tag in CELLS:
                    held.append(" ")
                todo += [c if isinstance(c, str) else (c, within) for c in reversed(node.children)]
            flush()
        return blocks, weight

    def find(tag: str) -> list[Node]:
        got, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag:
                got.append(node)
                continue
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and kept(c, False)]
        return got

    every, total = walk([root], False)
    for tag in ("article", "main"):
        tops = find(tag)
        if tops:
            blocks, weight = walk(tops, True)
            if 2 * weight >= total:
                return "\n\n".join(blocks)
    return "\n\n".join(every)


def host_of(url: str | None) -> str | None:
    """Lower-case host of an absolute URL, else null."""
    m = _HOST.match(url) if isinstance(url, str) else None
    return m[1].lower() or None if m else None


PRESENTS, HOLDS, SAYS, THERE = range(4)


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted pages to what they count for in their host's tree, summed over a bounded run of pages.

    kind PRESENTS: presentations of a path; HOLDS: features, SAYS: contents, each once a page; THERE:
    pages that have the path, with the characters of its own text.
    """

    def rows(seen: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(seen), columns=["host", "path", "kind", "x"]).astype({"kind": np.int8})
        out["x"] = out["x"].to_numpy(np.uint64).view(np.int64)
        both = np.array(list(seen.values()), float).reshape(-1, 2)
        return out.assign(n=both[:, 0], chars=both[:, 1])

    seen: dict[tuple, list[float]] = {}

    def add(key: tuple, n: float, chars: float = 0.0) -> None:
        have = seen.get(key)
        if have is None:
            seen[key] = [n, chars]
        else:
            have[0] += n
            have[1] += chars

    for pdf in batches:
        for host, page, w in zip(pdf["host"], pdf["html"], pdf["w"]):
            if not isinstance(host, str) or not isinstance(page, str):
                continue
            chars: Counter = Counter()
            once = set()
            for node in annotate(parse(page)):
                chars[node.path] += node.chars
                if not node.content:
                    continue
                signs = " ".join([c.sign for c in node.children if isinstance(c, Node)])
                add((host, node.path, PRESENTS, xxhash.xxh64_intdigest(signs)), w)
                once.update([(host, node.path, HOLDS, x) for x in features(node)])
                if judged(node):
                    once.add((host, node.path, SAYS, node.content))
            for key in once:
                add(key, w)
            for path, n in chars.items():
                add((host, path, THERE, 0), w, w * n)
            if len(seen) > 200_000:
                yield rows(seen)
                seen.clear()
    if seen:
        yield rows(seen)


def _host() -> F.Column:
    return F.nullif(F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def weighted(pages: DataFrame) -> DataFrame:
    """pages -> (host, html, w): w is 1 over the number of pages of the host with the same text, so copies count as one page.

    Text is what stands outside of tags, scripts and styles, white space as it is; splitting and replacing
    run in time in proportion to the page. The counts of texts on several pages are broadcast if few, else joined.
    """
    outside = F.filter(F.split("html", r"(?i)</?(?:script|style)\b"), lambda _, i: i % 2 == 0)
    words = F.regexp_replace(F.array_join(outside, " "), r"<[^<>]*>", "")
    rows = pages.select(_host().alias("host"), "html").where("host is not null and html is not null").withColumn("key", F.xxhash64("host", words))
    often = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    few = often.count() * 40 <= BROADCAST_BYTES
    return rows.join(F.broadcast(often) if few else often, "key", "left").select("host", "html", (1.0 / F.coalesce("n", F.lit(1))).alias("w"))


def trees(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages -> (host, path, pages, chars, importance), (host, key): presentation nodes, and content nodes that most pages of a host hold.

    importance is null for nodes without text or links of their own. Statistics are over distinct
    pages. All are sums over counts, pre-aggregated before each shuffle; a hot host spreads over its
    paths and features.
    """
    seen = weighted(pages).mapInPandas(_observe, "host string, path long, kind byte, x long, n double, chars double")
    by = cut_lineage(seen.groupBy("host", "path", "kind", "x").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")))
    of = lambda kind, v: F.sum(F.when(F.col("kind") == kind, v))
    # sums of 1 / copies stray from whole numbers by rounding
    d = F.greatest(F.round("n", 6), F.lit(1.0))
    nodes = by.groupBy("host", "path").agg(
        of(PRESENTS, d).alias("o"),
        of(PRESENTS, d * F.log(d)).alias("ol"),
        of(HOLDS, F.lit(1.0)).alias("f"),
        of(HOLDS, F.log(d)).alias("fl"),
        of(THERE, d).alias("pages"),
        of(THERE, F.col("chars")).alias("chars"),
    )
    shape = F.when(F.col("o") > 1, (F.log("o") - F.col("ol") / F.col("o")) / F.log("o")).otherwise(1.0)
    held = F.when(F.col("pages") > 1, 1 - F.col("fl") / F.col("f") / F.log("pages")).otherwise(1.0)
    score = F.when(F.col("f") > 0, F.greatest(F.lit(0.0), PRESENTATION * shape + (1 - PRESENTATION) * held))
    nodes = nodes.select("host", "path", "pages", "chars", score.alias("importance"))
    whole = nodes.where("path = 0").select("host", F.col("pages").alias("m"))
    common = by.where((F.col("kind") == SAYS) & (d >= MIN_SUPPORT)).join(whole, "host").where(2 * d > F.col("m"))
    return nodes, common.select("host", "path", "x")


def sites(pages: DataFrame) -> DataFrame:
    """A row per host with a node of MIN_SUPPORT distinct pages: host, paths, importance, common (path and content, hashed), limit."""
    nodes, common = trees(pages)
    nodes = nodes.where((F.col("pages") >= MIN_SUPPORT) & F.col("importance").isNotNull())
    mean = F.sum(F.col("chars") * F.col("importance")) / F.sum("chars")
    by_host = nodes.groupBy("host").agg(F.collect_list(F.struct("path", F.col("importance").cast("float").alias("importance"))).alias("nodes"), (SHARE * mean).alias("limit"))
    by_host = by_host.where("`limit` is not null")
    said = common.groupBy("host").agg(F.collect_list(F.struct("path", "x")).alias("common"))
    return cut_lineage(by_host.join(said, "host", "left").select("host", "nodes.path", "nodes.importance", "common", "limit"))


def _site(path, importance, common, limit) -> Site | None:
    if path is None:
        return None
    keys = frozenset(below(c["path"], c["x"] % (1 << 64)) for c in common) if common is not None else frozenset()
    return Site(dict(zip(map(int, path), map(float, importance))), keys, float(limit))


def _extract(shared):
    """Pages to texts; the sites are a broadcast by host, or else come with each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Site | None] = {}
        for pdf in batches:
            text = []
            for k, (host, page) in enumerate(zip(pdf["host"], pdf["html"])):
                if not isinstance(page, str):
                    text.append("")
                    continue
                if not isinstance(host, str):
                    site = None
                elif host in made:
                    site = made[host]
                else:
                    if len(made) >= 1000:
                        made.clear()
                    row = shared.value.get(host) if shared is not None else tuple(pdf[c].iloc[k] for c in ("path", "importance", "common", "limit"))
                    site = made[host] = _site(*row) if row is not None else None
                text.append(main_text(parse(page), site))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": np.fromiter(map(len, text), np.int64, len(text))})

    return run


def extract(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, text, n_chars), a row per row, repeated ones too.

    Null and empty html give an empty text. Pages whose url has no host are extracted without
    site statistics, as are those of hosts without a node on MIN_SUPPORT distinct pages. Time is
    in proportion to a page's length however deep it nests. An empty table gives an empty one.
    """
    spark = pages.sparkSession
    by_host = sites(pages)
    size = by_host.agg(F.sum(F.length("host") + 64 + 12 * F.size("path") + 16 * F.greatest(F.size("common"), F.lit(0))).alias("b")).first().b or 0
    rows = pages.select("page_id", "url", "html", _host().alias("host"))
    kind = dict(pages.dtypes)
    out = f"page_id {kind['page_id']}, url string, text string, n_chars long"
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: (r.path, r.importance, r.common, r.limit) for r in by_host.collect()})
        return rows.mapInPandas(_extract(shared), out)
    salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "host", "path", "importance", "common", "limit").mapInPandas(_extract(None), out)
