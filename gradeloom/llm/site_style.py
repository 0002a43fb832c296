"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one style tree: a node is a path of
tags with their classes and ids. For each node the pages' presentations (the
sequences of its children) and contents (a hash of what is below it) are counted, and
their entropies to the base of the number of pages give its importance:

    (1 - g^l) * H(presentation) + g^l * H(content),   g = 0.9, l presentations

A branch of low importance repeats itself over the host's pages and is removed
from each. Nodes under ``least`` pages have no say. Branches that are boilerplate
by their meaning (navigation, footers, forms, adverts, comments, ...) go at any
number of pages, but class words never take a wrapper that holds the page's only
``article`` or ``main``. Importance decides inside and outside of these alike. Where
a whole ``article`` or ``main`` repeats, it is a copied text and stays.

Counts are by host and node with partial sums, so a hot host is spread over
tasks; a page meets only the list of its host's low nodes. Spark broadcasts that
list if its files are small, else joins by host.

Text: character references are decoded, white space in a block becomes one
space, blocks are trimmed and joined in page order by one space.

Defined cases: a null html is empty and gives an empty text. A null url or one
without a host belongs to a nameless host. Unclosed and stray tags are read as
browsers do: the end of an element closes what is open inside it. Repeated rows
count as pages each. An empty table gives an empty table. Columns other than the
three are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import bounded_batches, materialize

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Element kinds of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text.
BOILERPLATE = frozenset("nav footer aside form button select dialog menu head".split())
MAIN = frozenset(("article", "main"))
#: Words of classes, ids and roles that name boilerplate.
NOISE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar side aside "
    "widget widgets cookie cookies consent gdpr notice notices alert notification comment comments commentlist disqus replies reply respond share sharing social related recommended newsletter subscribe subscription "
    "signup login search popup modal overlay pagination pager toolbar copyright skip toc tags tagcloud contentinfo complementary".split()
)
#: Roles that name the main text.
MAIN_NAMES = frozenset("article main".split())
#: Elements that close an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("ul ol dl table div section article main body td th".split())


@dataclass
class Node:
    tag: str
    name: str
    path: int
    main: bool
    noise: bool
    weak: bool
    children: list[Node | str] = field(default_factory=list)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _open(tag: str, raw: str, parent: Node) -> Node:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip() else {}
    marks = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    words = {w for m in marks for w in re.split(r"[^a-z]+", m)}
    role = found.get("role", "").lower()
    name = ".".join([tag, *(re.sub(r"\d+", "0", m) for m in marks)])
    main = tag in MAIN or role in MAIN_NAMES
    sure = tag in BOILERPLATE or tag in RAW or "hidden" in found or found.get("aria-hidden") == "true" or role in NOISE or (tag == "header" and not parent.main)
    weak = not sure and not main and bool(words & NOISE) and tag not in ("body", "html")
    inside = parent.main and not (sure or weak)
    return Node(tag, name, _hash(f"{parent.path}>{name}"), main or inside, sure or weak, weak)


def parse(page: str) -> Node:
    """The page as a tree; texts are decoded strings, ``<br>`` is a node."""
    root = Node("", "", 0, False, False, False)
    stack, at = [root], 0
    m = TOKEN.search(page)
    while m:
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1] is not None:
            stack[-1].children.append(m[1])
        elif tag and m[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and not (tag in INLINE and any(n.tag in SCOPE for n in stack[depth + 1 :])):
                del stack[depth:]
        elif tag:
            shut = CLOSES.get(tag, {"p"} if tag in BREAKS_P else set()) | ({"p"} if tag in BREAKS_P else set())
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in shut:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE:
                        break
            node = _open(tag, m[4], stack[-1])
            stack[-1].children.append(node)
            if tag in RAW and not m[4].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID:
                stack.append(node)
        m = TOKEN.search(page, at)
    if at < len(page):
        stack[-1].children.append(entities.unescape(page[at:]))
    if not _holders(root, False):
        for node in _holders(root, True):
            node.noise = False
    return root


def _holders(root: Node, weak: bool) -> list[Node]:
    """The nodes that hold a main element; ``weak``: also through nodes that only class words mark."""
    out: dict[int, Node] = {}
    order, up = [root], {id(root): None}
    for node in order:
        for c in node.children:
            if not isinstance(c, str) and (not c.noise or (weak and c.weak)):
                up[id(c)] = node
                if c.main:
                    above = node
                    while above is not None and id(above) not in out:
                        out[id(above)] = above
                        above = up[id(above)]
                else:
                    order.append(c)
    return list(out.values())


def texts(root: Node, low: frozenset[int] | set[int]) -> list[list[str]]:
    """The blocks of a page in order: lists of strings to be joined; a block begins and ends with each block element."""
    blocks: list[list[str]] = [[]]
    holders = {id(n) for n in _holders(root, False)} if low else set()
    todo: list[tuple[Node | str | None, bool, bool]] = [(c, False, False) for c in reversed(root.children)]
    while todo:
        node, inside, copied = todo.pop()
        if node is None:
            blocks.append([])
        elif isinstance(node, str):
            blocks[-1].append(node)
        elif not node.noise:
            first = node.main and not inside
            if node.path in low and not (first or copied or id(node) in holders):
                continue
            if node.tag not in INLINE:
                blocks.append([])
                todo.append((None, False, False))
            state = inside or node.main, copied or (first and node.path in low)
            todo += [(c, *state) for c in reversed(node.children)]
    return blocks


def main_text(page: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page of a host with these low nodes."""
    return " ".join(t for b in texts(parse(page), low) if (t := " ".join("".join(b).split())))


def page_nodes(page: str) -> list[tuple[int, int, int]]:
    """(path, presentation, content) of every node that could be removed for repeating, once a path."""
    order, todo = [], [parse(page)]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str) and not c.noise]
    below: dict[int, int] = {}  # content by node: a hash over what is below it
    looks: dict[int, list[str]] = {}
    holds: dict[int, list[str]] = {}
    for node in reversed(order):
        parts, names = [], []
        for c in node.children:
            if isinstance(c, str):
                if not c.isspace():
                    parts.append(" ".join(c.split()))
            elif not c.noise:
                parts.append(str(below[id(c)]))
                names.append(c.name)
        below[id(node)] = _hash("\n".join(parts)) if parts else 0
        if node.path and node.tag not in INLINE and node.tag not in ("html", "body"):
            looks.setdefault(node.path, []).append("|".join(dict.fromkeys(names)))
            holds.setdefault(node.path, []).append(str(below[id(node)]))
    # nodes of one path stand or fall together, so all of them count
    return [(k, _hash("||".join(dict.fromkeys(looks[k]))), _hash("\n".join(v))) for k, v in holds.items()]


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, presentation, content): the nodes of every page of ``pages`` (host, html), once a page."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at, rows = [], []
            for i, page in enumerate(b.column(1).to_pylist()):
                own = page_nodes(page or "")
                at += [i] * len(own)
                rows += own
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], ["host", "path", "presentation", "content"])

    return pages.select("host", "html").mapInArrow(run, "host string, path bigint, presentation bigint, content bigint")


def importance(nodes: DataFrame, decay: float = 0.9) -> DataFrame:
    """(host, path, pages, importance) of every node of the style trees."""

    def entropy(of: str) -> DataFrame:
        counts = nodes.groupBy("host", "path", of).agg(F.count("*").alias("n"))
        return counts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))

    h = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages"))
    p = entropy("presentation").select("host", "path", "pages", "kinds", h.alias("hp"))
    c = entropy("content").select(F.col("host").alias("host2"), F.col("path").alias("path2"), h.alias("hc"))
    both = p.join(c, F.col("host").eqNullSafe(F.col("host2")) & (F.col("path") == F.col("path2")))
    g = F.pow(F.lit(decay), F.col("kinds"))
    return both.select("host", "path", "pages", F.when(F.col("pages") > 1, (1 - g) * F.col("hp") + g * F.col("hc")).otherwise(F.lit(1.0)).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least: int = 8, threshold: float = 0.35) -> DataFrame:
    """(id, url, text) of every page."""
    spark = pages.sparkSession
    bounded_batches(spark, 200)
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    low = importance(style_nodes(own)).where((F.col("pages") >= least) & (F.col("importance") < threshold))
    low = materialize(low.groupBy("host").agg(F.collect_set("path").alias("low")), "style-low").withColumnRenamed("host", "of")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, set[int]] = {}
        for b in parts:
            out = []
            for page, nodes in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                key = tuple(nodes or ())
                if key not in seen:
                    seen = {key: set(key)} if len(seen) > 1000 else seen | {key: set(key)}
                out.append(main_text(page or "", seen[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    joined = own.join(low, F.col("host") == F.col("of"), "left").select("id", "url", "html", "low")
    return joined.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
