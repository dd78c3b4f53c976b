"""Main text of web pages by composite text density.

A page is parsed to a tree with the implied end tags of HTML. Parts that are never the article
(scripts, forms, menus, footers, what its class, id or role names as advert, notice, sidebar, comments)
are pruned; inside article and main names count for containers only, and only whole ones. Each node's composite density is its characters per tag, adjusted by the shares of link
characters and link tags; the sum of the densities of its child blocks picks the subtree, twice as much
counting for article and main. The least density on the path from there to body is the threshold: blocks
beside it that reach it, down from body, give the node of their greatest sum too.

Nulls: null html gives an empty text. Truncated markup is read as far as it goes. Columns other than
those named are not read; repeated rows give equal rows; pages may be of any length."""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm._shared import map_batches, texts_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "meta", "link"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}

CONTAINERS = {"div", "ul", "ol", "dl", "table", "figure", "center"}
NEVER = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "form", "button", "select", "textarea", "input", "nav", "menu", "footer", "aside", "dialog", "title", "noembed", "noframes", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "tablist", "status"}
WORDS = {"ad", "ads", "adv", "advert", "adverts", "nav", "navbar", "menu", "footer", "sidebar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "banner", "popup", "modal", "overlay", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "social", "share", "sharing", "related", "recommended", "recommendations", "newsletter", "subscribe", "signup", "login", "breadcrumb", "breadcrumbs", "pagination", "pager", "sponsor", "sponsored", "promo", "promotion", "masthead", "widget", "toolbar", "skip", "paywall", "alert", "aside", "toc", "header", "advertisement", "advertising", "topbar", "alerts", "discussion"}
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
BONUS = 2  # for the density sum of article and main


class Node:
    __slots__ = ("tag", "parent", "children", "pruned", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, pruned: bool):
        self.tag, self.parent, self.pruned = tag, parent, pruned
        self.children: list[Node | str] = []


def unwanted(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside_article:
        return True
    if not attributes or tag in {"html", "body", "article", "main"}:
        return False
    for name, x, y, z in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (x or y or z).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" and tag not in INLINE:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in {"class", "id"}:
            for token in value.split():
                words = SPLIT.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token))
                if inside_article:  # whole names of containers alone; headings, paragraphs and sections are text
                    if tag in CONTAINERS and WORDS.issuperset(words):
                        return True
                    continue
                if WORDS.intersection(words) and not {"article", "content", "post", "entry", "main"}.intersection(words[:1]):
                    return True
                if WORDS.intersection(words) and words[-1] in {"comments", "comment", "ad", "ads", "nav", "footer", "sidebar", "menu", "related", "share", "header"}:
                    return True
    return False


def parse(html: str) -> Node:
    """The tree. Pruned parts keep their place but not their text."""
    root = Node("html", None, False)
    at, here, n = 0, root, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not here.pruned:
            here.children.append(html[at:end])
        if not m:
            break
        at = m.end()
        closing, opening = m.group(1), m.group(2)
        if closing:
            tag = closing.lower()
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            elif tag == "p" and not here.pruned:
                here.children.append(Node("p", here, False))
        elif opening:
            if not m.group(0).endswith(">"):
                break  # cut off inside a tag
            tag = opening.lower()
            if tag in {"html", "body"}:
                if tag == "body":
                    while here is not root:
                        here = here.parent
                    body = Node("body", root, False)
                    root.children.append(body)
                    here = body
                continue
            if tag in CLOSES_P:
                node = here
                while node is not root and node.tag in INLINE:
                    node = node.parent
                if node.tag == "p":
                    here = node.parent
            if tag in IMPLIED:
                ends, fence = IMPLIED[tag]
                node, found = here, None
                while node is not root and node.tag not in fence:
                    if node.tag in ends:
                        found = node
                    node = node.parent
                if found is not None:
                    here = found.parent
            elif tag == "a":
                node = here
                while node is not root and node.tag in INLINE and node.tag != "a":
                    node = node.parent
                if node.tag == "a":
                    here = node.parent
            node = here
            while node is not None and node.tag not in {"article", "main"}:
                node = node.parent
            child = Node(tag, here, here.pruned or unwanted(tag, m.group(3), node is not None))
            if not here.pruned:
                here.children.append(child)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                if not child.pruned:
                    child.children.append(html[at : close.start() if close else n])
                at = close.end() if close else n
            elif tag not in VOID and not m.group(3).rstrip().endswith("/") or tag not in VOID and tag not in {"svg", "math"} and m.group(3).rstrip().endswith("/") and tag in CLOSES_P:
                here = child
    return root


def ordered(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.pruned]
    return out


def measure(root: Node) -> tuple[list[Node], Node]:
    """Counts and densities of all nodes that stay; the nodes, and body."""
    nodes = ordered(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) - c.count("  ") - (c.isspace() and len(c))
            elif not c.pruned:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        node.chars = max(node.chars, 0)
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if node.tag == "a":
            lc = c
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            node.density = c / t * max(math.log(c / max(lc, 1) * t / lt + 1e-9), 0.0) / max(base, 1e-9)
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.pruned and x.tag not in INLINE)
    return nodes, body


def choose(root: Node) -> list[Node]:
    """The outermost nodes of the main text, in their order.

    The greatest density sum picks a node; the least density on its path to body is the threshold. Of each
    subtree that reaches it and whose path does, the node of the greatest sum is content too."""
    nodes, body = measure(root)
    inside = [x for x in nodes if x.chars]
    if not inside:
        return [body]
    score = lambda x: (x.total * (BONUS if x.tag in {"article", "main"} else 1), x.density)
    peak: dict[Node, Node] = {}
    for node in reversed(inside):
        peak[node] = max([node, *(peak[c] for c in node.children if isinstance(c, Node) and c in peak)], key=score)
    best = peak[body] if body in peak else max(inside, key=score)
    threshold, node = body.density, best
    while node is not None and node is not body:
        threshold, node = min(threshold, node.density), node.parent
    content, reached = {best}, {body}
    for node in inside:
        if node.parent in reached and node.density >= threshold and node.tag not in INLINE:
            reached.add(node)
            content.add(peak[node])
    return [x for x in inside if x in content and not above(x, content)]


def above(node: Node, content: set[Node]) -> bool:
    here = node.parent
    while here is not None and here not in content:
        here = here.parent
    return here is not None


def text_of(tops: list[Node]) -> str:
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            block = SPACE.sub(" ", unescape("".join(now))).strip()
            if block:
                blocks.append(block)
            now.clear()

    stack: list[Node | str | None] = list(reversed(tops))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.pruned:
            if x.tag not in INLINE:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return " ".join(blocks)


def main_text(html: str) -> str:
    return text_of(choose(parse(html))) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, keep..., text, n_chars) of every page."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in texts_of(batch.column(batch.num_columns - 1))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, *keep, "text", "n_chars"])

    source = pages.select(id_col, *keep, html_col)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return map_batches(source, kernel, f"{kept}, text string, n_chars long")
