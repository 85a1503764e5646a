"""Main text of web pages by composite text density.

For every element of a page: C characters of text, T tags, of these LC characters and LT tags inside
links. Its density is characters per tag, lowered by links:

    C/T * log(C/LC * T/LT) / log(log(C/(C-LC) * LC + LCb/Cb * C + e)),   b: the whole body

(a zero counts as one where it divides). The element whose children's densities have the largest sum
holds the main text (paragraphs, headings and inline elements cannot). The least density on the path from it to the body is the threshold: inside the
element, a child that is mostly links and below the threshold is left out. Everything else in it is
kept whole, in page order. Tags only widen it: to the nearest ``article`` or ``main`` around it, if all that
this adds beside the path agrees, which means headings, and text that reaches the threshold and is not
mostly links.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments take no
part: they are known by their tag or, for block containers that do not hold the densest element of the
whole page, by a word of their class, id or role. Headings, paragraphs and inline elements have no words.
Inside the main element only words for adverts, notices, comments and the like decide alone. A container with another
of the words is part of the text if it is not mostly links and either as dense as the element around it, or holds the
headline, or is mostly headings.

Each page is worked alone, in Arrow batches, with an explicit stack (no recursion, any depth), in time linear in
its length, however malformed it is.

Defined cases. Null or empty html, and pages without text, give an empty text. Unclosed and stray tags
are closed or skipped as browsers do for paragraphs, list items and cells. Rows are independent, so
repeated or null ids do not matter. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import in_batches

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:(?<=\s)|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_LEFT_OUT = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "map"}
# Words that say what a container is: adverts, notices, comments and page furniture, whatever their text is like.
_SURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie",
    "cookies", "disqus", "navbar", "newsletter", "notice", "pagination", "popup", "promo", "sidebar", "sponsor", "sponsored",
}
# Words that a part of an article may have too.
_OUT_WORDS = _SURE_WORDS | {
    "banner", "footer", "header", "login", "menu", "modal", "nav", "navigation", "related", "search", "share", "sharing", "social", "subscribe", "toolbar", "widget",
}
_BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    *(_LEFT_OUT - {"button", "object", "map"}),
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
# Parts of a line or single lines: they never hold the main text as a whole.
_LINES = {
    "p", "a", "abbr", "b", "big", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", *_HEADINGS,
}
# Only these are left out by a word of their class, id or role.
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "fieldset", "details", "center"}
# A start tag of the key ends open elements of the value, up to the nearest of the barrier.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"ul", "ol", "dl", "table", "body", "article", "main", "section", "div"}


class Node:
    __slots__ = ("tag", "parent", "out", "link", "chars", "tags", "link_chars", "link_tags", "head_chars", "headline", "children", "parts", "density", "named", "sure", "void")

    def __init__(self, tag: str, parent: "Node | None", out: bool, named: bool = False):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.link = tag == "a" or bool(parent and parent.link)
        self.chars = self.tags = self.link_chars = self.link_tags = self.head_chars = self.void = 0
        self.children, self.parts, self.density, self.headline, self.sure = [], [], 0.0, False, False


def _words(tag: str, rest: str) -> set[str]:
    """Those words of class, id and role that may take out a block container."""
    if tag not in _CONTAINERS or "=" not in rest:
        return set()
    return {w for found in _NAMES.findall(rest) for w in re.split(r"[^a-z]+", "".join(found).lower())} & _OUT_WORDS


class Marks:
    """The marks of a page, one after another; nothing is looked at more than a fixed number of times.

    What cannot follow is remembered: where the last ``>`` is, and the opening quotes from which no tag ends.
    """

    def __init__(self, page: str):
        self.page, self.last, self.endless = page, page.rfind(">"), set()

    def after(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, tag, attributes, whether it is an end tag) of the next mark; no tag for comments and the like."""
        page = self.page
        start = page.find("<", at)
        while 0 <= start:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, (end + 3 if end >= 0 else len(page)), "", "", False
            if start > self.last:  # only a comment can follow
                start = page.find("<!--", start)
                continue
            found = _TAG.match(page, start)
            if found:
                end = self._close(found.end())
                rest = page[found.end() : end] if end >= 0 else ""
                return start, (end if end >= 0 else page.find(">", found.end())) + 1, found[2].lower(), rest, bool(found[1])
            if page[start + 1] in "!?/":
                return start, page.find(">", start) + 1, "", "", False
            start = page.find("<", start + 1)
        return None

    def _close(self, at: int) -> int:
        """Where the tag ends whose attributes begin here: the first ``>`` outside of quotes, or -1."""
        seen = []
        while found := _STOP.search(self.page, at):
            if found[0] == ">":
                return found.start()
            if found.start() in self.endless:
                break
            seen.append(found.start())
            at = self.page.find(found[0], found.end()) + 1
            if not at:
                break
        self.endless.update(seen)
        return -1

    def past(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup."""
        close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.page, at)
        return self.page.find(">", close.end()) + 1 if close and close.end() <= self.last else len(self.page)


class Path:
    """The open elements, with the places of each tag and of the barriers among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.barriers = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _BARRIER:
            self.barriers.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in _BARRIER:
                self.barriers.pop()

    def end(self, tag: str) -> None:
        """Close the innermost element of that tag; a stray end tag closes nothing."""
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def end_before(self, tags: set[str]) -> None:
        """Close the outermost element of those tags inside the nearest barrier."""
        lists = [self.places[t] for t in tags if self.places.get(t)]
        inside = [places[k] for places in lists if (k := bisect_right(places, self.barriers[-1])) < len(places)]
        if inside:
            self.cut(min(inside))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all elements in page order; a part of an element is a text or a child. Linear in the page."""
    root = Node("#root", None, False)
    nodes, path, marks, at = [root], Path(root), Marks(page), 0
    while True:
        found, top = marks.after(at), path.nodes[-1]
        text = page[at : found[0]] if found else page[at:]
        if text and not top.out:
            top.parts.append(html.unescape(text))
        if not found:
            return root, nodes
        _, at, tag, rest, is_end = found
        if not tag:
            continue
        if is_end:
            path.end(tag)
        elif tag in _RAW:
            at = marks.past(tag, at)
        elif tag in _VOID:
            if not top.out:
                top.void += 1
                top.parts.append(" " if tag != "hr" else "\n\n")
        else:
            closes = _ENDS.get(tag) or ({"p"} if tag in _BLOCKS else None)
            if closes:
                path.end_before(closes)
                top = path.nodes[-1]
            out = top.out or tag in _LEFT_OUT
            words = set() if out else _words(tag, rest)
            node = Node(tag, top, out, bool(words))
            node.sure = not words.isdisjoint(_SURE_WORDS)
            if not out:
                top.children.append(node)
                top.parts.append(node)
                nodes.append(node)
            path.push(node)


def _measure(nodes: list[Node]) -> None:
    """Counts from the leaves up, then densities."""
    for node in nodes:
        node.chars = node.link_chars = node.link_tags = node.head_chars = 0
        node.tags = node.void
        node.density, node.headline = 0.0, False
    for node in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars += own
        node.link_chars += own if node.link else 0
        node.head_chars = node.chars if node.tag in _HEADINGS else node.head_chars
        node.headline = node.headline or (node.tag == "h1" and node.chars > 0)
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.head_chars += node.head_chars
            up.headline = up.headline or node.headline
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if not c:
            continue
        base = log(c / max(1, c - lc) * lc + share * c + e)
        ratio = c / max(1, lc) * t / max(1, lt)
        node.density = c / t * (log(ratio) / log(base) if ratio > 1 and base > 1 and log(base) > 1e-9 else (log(ratio) if ratio > 1 else 0.0))


def _without_named(nodes: list[Node]) -> list[Node]:
    """The elements outside named containers, but those that hold the densest element stay.

    The others remain among the parts of their elements, with the measures they have.
    """
    node = _densest(nodes)
    while node:
        node.named, node = False, node.parent
    left = []
    for node in nodes:
        node.out = node.named or bool(node.parent and node.parent.out)
        if not node.out:
            left.append(node)
    for node in left:
        if any(x.out for x in node.children):
            node.children = [x for x in node.children if not x.out]
    return left


def _belongs(node: Node, top: Node) -> bool:
    """Whether a named container inside the main element is part of the text after all."""
    return not node.sure and 2 * node.link_chars <= node.chars and (node.density >= top.density or node.headline or 2 * node.head_chars >= node.chars)


def _densest(nodes: list[Node]) -> Node:
    """The element with the largest sum of its children's densities; paragraphs, headings and inline elements are not asked."""
    return max((n for n in nodes if n.tag not in _LINES), key=lambda n: sum(x.density for x in n.children))


def main_node(nodes: list[Node]) -> tuple[Node, float]:
    """The element with the largest sum of its children's densities, and the threshold of its path."""
    best = _densest(nodes)
    path, node = [best.density], best
    while node.parent and node.tag != "body":
        node = node.parent
        path.append(node.density)
    threshold, node, agree = min(path), best, True
    while agree and node.parent and node.tag not in ("article", "main"):
        up = node.parent
        agree = all(x is node or not x.chars or x.tag in _HEADINGS or (x.density >= threshold and 2 * x.link_chars <= x.chars) for x in up.children)
        node = up
    return (node if agree and node.tag in ("article", "main") else best), threshold


def main_text(page: str | None) -> str:
    root, nodes = parse(page or "")
    _measure(nodes)
    if any(n.named for n in nodes):
        nodes = _without_named(nodes)
        _measure(nodes)
    if not root.chars:
        return ""
    top, threshold = main_node(nodes)
    blocks, now = [], []

    def end():
        block = " ".join("".join(now).split())
        now.clear()
        if block:
            blocks.append(block)

    todo = [(top, 0)]
    while todo:
        node, k = todo.pop()
        if k == len(node.parts):
            if node.tag in _BLOCKS:
                end()
            continue
        todo.append((node, k + 1))
        part = node.parts[k]
        if isinstance(part, str):
            now.append(part)
            if part == "\n\n":
                end()
        elif part.named and not _belongs(part, top):
            end()
        elif not (part.tag in _BLOCKS and 2 * part.link_chars > part.chars and part.density < threshold):
            if part.tag in _BLOCKS:
                end()
            todo.append((part, 0))
    end()
    return "\n\n".join(blocks)


def _extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(t) for t in batch["html"].to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
    )


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return in_batches(rows, _extracted, "page_id long, url string, text string, n_chars long")
