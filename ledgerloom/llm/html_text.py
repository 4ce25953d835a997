"""Main text of web pages by composite text density.

A page becomes a tree of elements. Boilerplate that its markup names (menus, forms, adverts, comments and the like) is
cut off. Each node's composite text density is its characters per tag, lowered by the share of link text around it; a
node's density sum is the sum of its children's densities. The node of the largest sum is the core; the least density
on the path from the body to it is the threshold. From the body down, each subtree that passes the threshold gives its
node of the largest sum, so that a text in several containers is kept, with the headings right before each. Elements
within a line of text (INLINE) are no containers: their characters and tags count for the node around them, but they have
no part in sums and are never chosen by themselves. Densities alone choose; article and main elements have no privilege.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[\"']?>|<[!?][^>]*>|</[^>]*>|</?[a-zA-Z!][^<>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
DROPPED = frozenset("script style textarea title xmp noscript iframe noembed noframes template head nav footer aside form button select option dialog menu svg canvas object map audio video input label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes these open elements, up to the nearest of the second group.
CLOSES = {t: ("p",) for t in BLOCKS - {"html", "body"}} | {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"),
    "th": ("p", "td", "th"), "option": ("option",), "tbody": ("p", "td", "th", "tr", "thead", "tbody"),
}
HOLDS = frozenset("ul ol dl table article section div main body nav aside footer header form blockquote".split())
#: Parts of class and id names, and roles, of what isn't the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice popup modal overlay comment comments disqus respond replies reply share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login widget toolbar pagination pager masthead banner alert skip toc".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
KEPT_WHOLE = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "link_chars", "tags", "link_tags", "density", "total", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate(tag: str, attributes: str, parent: Node) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        while parent is not None:
            if parent.tag in ("article", "main"):
                return False
            parent = parent.parent
        return True
    if not attributes or tag in KEPT_WHOLE:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and any(p.lower() in NAMED for p in PART.findall(value)):
            return True
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str) -> Node:
    """The page's tree; anything may be unclosed or closed without an opening."""
    root = now = Node("#root", None, False)
    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        start = m.start() if m else size
        if start > at:
            now.children.append(page[at:start])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                now = node.parent
            continue
        if shut := CLOSES.get(tag):
            node = now
            while node.parent is not None and node.tag not in HOLDS:
                if node.tag in shut:
                    now = node.parent
                node = node.parent
            if tag in ("li", "dt", "dd", "td", "th", "tr", "tbody") and now.tag in shut:
                now = now.parent
        child = Node(tag, now, now.dropped or _boilerplate(tag, m[3], now))
        now.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            now = child
    return root


def _in_order(root: Node) -> list[Node]:
    """Nodes that aren't dropped, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped]
    return out


def measure(body: Node) -> list[Node]:
    """Composite text density and density sum of each node below body."""
    nodes = _in_order(body)
    for n in reversed(nodes):
        n.chars = n.link_chars = n.tags = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(c.split()))
            elif not c.dropped:
                n.chars += c.chars
                n.link_chars += c.link_chars
                n.tags += c.tags + 1
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    ratio = body.link_chars / max(1, body.chars)
    for n in reversed(nodes):
        if n.chars:
            plain = max(1, n.chars - n.link_chars)
            base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
            links = (n.chars / max(1, n.link_chars)) * (max(1, n.tags) / max(1, n.link_tags))
            n.density = n.chars / max(1, n.tags) * (math.log(max(links, 1.0)) + 1) / base
        n.total = sum(c.density for c in containers(n))
    return nodes


def containers(node: Node) -> list[Node]:
    """A node's children that may hold a text by themselves."""
    return [c for c in node.children if not isinstance(c, str) and not c.dropped and c.tag not in INLINE]


def _path(node: Node, body: Node) -> list[Node]:
    out = [node]
    while out[-1] is not body:
        out.append(out[-1].parent)
    return out


def main_nodes(root: Node) -> list[Node]:
    """The subtrees of the main text, in page order, none within another."""
    every = _in_order(root)
    body = next((n for n in every if n.tag == "body"), root)
    nodes = measure(body)
    if not body.chars:
        return [body]
    every = [n for n in nodes if n is body or n.tag not in INLINE]
    core = max(every, key=lambda n: (n.total, n.chars))
    if core is body:
        return [body]
    threshold = min(n.density for n in _path(core, body))
    # A single block beside the core, as an advert or a notice is, has to be as dense as the core's blocks are on average.
    usual = max(threshold, core.total / max(1, sum(c.chars > 0 for c in containers(core))))
    best = {}
    for n in reversed(nodes):
        best[n] = max([n, *(best[c] for c in containers(n))], key=lambda x: (x.total, x.chars))
    out, todo = [], [body]
    chosen = {core}
    while todo:
        n = todo.pop()
        if n in chosen:
            out.append(n)
            continue
        if n.density >= (threshold if n.total else usual) and n.chars:
            chosen.add(best[n])
            if best[n] is n:
                out.append(n)
                continue
        todo += reversed(containers(n))
    return _with_headings(out)


def _with_headings(found: list[Node]) -> list[Node]:
    """The subtrees, each after the headings right before it."""
    out: list[Node] = []
    for n in found:
        before = []
        if n.parent is not None:
            sides = [c for c in n.parent.children if not isinstance(c, str) and not c.dropped and (c.chars or c is n)]
            for c in reversed(sides[: sides.index(n)]):
                if c.tag not in HEADINGS or c in found:
                    break
                before.append(c)
        out += [*reversed(before), n]
    return out


def blocks(node: Node) -> list[str]:
    """Text of a subtree's blocks in page order: references decoded, white space as one space, no empty blocks."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            if text := " ".join(html.unescape("".join(now)).split()):
                out.append(text)
            now.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            now.append(n)
        elif n.dropped:
            if n.tag in BLOCKS:
                end()
        else:
            if n.tag == "br":
                now.append("\n")
            elif n.tag in BLOCKS or n.tag == "#root":
                end()
                todo += [None, *reversed(n.children)]
            else:
                todo += reversed(n.children)
    end()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(b for n in main_nodes(parse(page)) for b in blocks(n)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Defined cases: a null or empty page has an empty text, as has one without text outside boilerplate; repeated rows are
    answered each; page_id and url pass as they are, nulls too; other columns are ignored.
    """
    bounded(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
