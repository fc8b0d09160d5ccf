"""Main text of web pages by composite text density.

Method. The page is read into a tree of elements. What its tag or role names as page furniture (menus, adverts, forms,
reader comments and so on) is taken out, and so is what a whole class or id, or its last part, names so, unless it is
a heading, an article, holds the title, or holds most of the text of the page or of its articles. Every node then gets the composite text density

    C/T * log( C/LC * T/LT )  to the base  ln( C/(C-LC) * LC + LCb/Cb * C + e )

of its characters C, tags T, link characters LC and link tags LT (b: of the body; a zero counts as 1). The node
with the largest sum of the densities of its child blocks holds the main text (of equal ones an <article> or <main>, then the
outer one); from there it goes down as long as one container alone holds the title (<h1>) and blocks beside it. The smallest density on the path from the body to it is the threshold. Inside that node all text
counts but subtrees of mostly link text below the threshold. Beside it, on the path, those paragraphs count that reach the
threshold, those containers whose child blocks' densities reach it in sum, and headings before the node.
Names of elements and classes do not choose the node.

A text is the blocks in page order, joined by line feeds; white space within a block, line breaks included, is one
space. Defined results: a tag that never ends is text; null, empty and text-free pages give the empty text; unclosed and stray tags are read as a
browser does, in outline.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_lists

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that are text themselves; the other blocks are containers.
TEXTS = HEADINGS | set("p pre blockquote ul ol dl table figure center address li".split())
FURNITURE = set(
    "head script style noscript template iframe object embed svg canvas audio video map form input button select "
    "textarea fieldset nav footer aside menu dialog search".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr notice popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "commentlist disqus respond reply replies widget toolbar pagination pager skip copyright".split()
)
#: Names that an article's own header may have.
HEADS = {"header", "masthead"}
SECTIONS = {"html", "body", "article", "main"}
#: Starting one of these ends an open one of the same set, up to the named container.
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ITEMS |= {t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")} | {"tr": ({"tr"}, {"table"})}


class Node:
    __slots__ = ("tag", "up", "items", "chars", "tags", "link_chars", "link_tags", "density", "junk", "named")

    def __init__(self, tag: str, up: Node | None, junk: bool, named: str = ""):
        self.tag, self.up, self.junk, self.named, self.items = tag, up, junk, named, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _furniture(tag: str, attributes: str, inside: bool) -> bool:
    """inside: an <article> or <main> is open, whose own header belongs to the text."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not attributes or tag in SECTIONS and tag != "article":
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(tag: str, attributes: str, inside: bool) -> str:
    """"head" or "other" if a class or id, or its last part, is the name of a page's head or of other furniture."""
    if not attributes or tag in SECTIONS or tag in HEADINGS:
        return ""
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for value in (m[2] or m[3] or m[4] or "").lower().split():
                found = NAMES.intersection((value, re.split(r"[^a-z0-9]+", value)[-1]))
                if found and not (inside and found <= HEADS):
                    return "head" if found <= HEADS else "other"
    return ""


def _take_out(root: Node) -> None:
    """Named elements become furniture, with all they hold, unless they hold most of the text."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        order.append((node, inside))
        stack += [(x, inside) for x in node.items if isinstance(x, Node) and not x.junk]
    size: dict[Node, tuple[int, int, bool]] = {}  # characters: all, and those in articles; whether it holds a title
    for node, inside in reversed(order):
        parts = [size[x] for x in node.items if isinstance(x, Node) and not x.junk]
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        size[node] = own + sum(p[0] for p in parts), own * inside + sum(p[1] for p in parts), node.tag == "h1" or any(p[2] for p in parts)
    total, articles, _ = size[root]
    for node, _ in order:
        chars, within, title = size[node]
        if node.up is not None and node.up.junk:
            node.junk = True
        elif node.named and not (node.named == "head" and title):
            node.junk = not (2 * within > articles or 2 * chars > total and 4 * (articles - within) < chars)


def tree(page: str) -> Node:
    root = here = Node("html", None, False)
    at, depth = 0, 0  # depth: of open article and main elements
    count: Counter[str] = Counter()  # open elements by tag, so that a stray end costs nothing
    last_end = page.rfind(">")  # no tag ends after this

    def close(node: Node, last: Node) -> Node:
        nonlocal depth
        while True:
            depth -= node.tag in ("article", "main")
            count[node.tag] -= 1
            done = node is last
            node = node.up
            if done:
                return node

    def opened(tags: set[str], stop: set[str]) -> Node | None:
        if not any(count[t] for t in tags):
            return None
        node = here
        while node is not root:
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
            node = node.up
        return None

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > last_end:
            here.items.append(page[at:])
            break
        m = TOKEN.match(page, start) if start < len(page) else None
        if m is None and start < len(page):  # a bare "<" is text
            here.items.append(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            here.items.append(page[at:start])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = opened({tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div") else set())
            if node is not None:
                here = close(here, node)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK and (p := opened({"p"}, {"table", "article", "section", "div", "td", "li", "blockquote"})):
            here = close(here, p)
        if tag in HEADINGS and (h := opened(HEADINGS, BLOCK - HEADINGS)):
            here = close(here, h)
        if tag in ITEMS and (item := opened(*ITEMS[tag])):
            here = close(here, item)
        junk = here.junk or _furniture(tag, m[3] or "", depth > 0)
        node = Node(tag, here, junk, "" if junk else _named(tag, m[3] or "", depth > 0))
        here.items.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            here = node
            count[tag] += 1
            depth += tag in ("article", "main")
    _take_out(root)
    return root


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes outside furniture; they are returned with the parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        for x in node.items:
            if isinstance(x, Node) and not x.junk:
                stack.append(x)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x.strip())
        if node.tag == "a":
            node.link_chars = node.chars
        if node.up is not None:
            up = node.up
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    body = order[0]
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1.01))
    return order


def density_sum(node: Node) -> float:
    """Sum of the densities of the blocks in a node; what is not a block is part of its block's text."""
    return sum(x.density for x in node.items if isinstance(x, Node) and not x.junk and x.tag in BLOCK)


def _beside(x: Node, threshold: float) -> bool:
    """True if a sibling of the path belongs to the main text."""
    if 2 * x.link_chars >= x.chars:
        return False
    return x.density >= threshold if x.tag in TEXTS or x.tag not in BLOCK else density_sum(x) >= threshold


def _heading(x: Node) -> bool:
    """A heading, or an element that holds nothing but headings."""
    if x.tag in HEADINGS:
        return True
    inner = [y for y in x.items if isinstance(y, Node) and not y.junk and y.chars]
    return bool(inner) and sum(y.chars for y in inner) == x.chars and all(y.tag in HEADINGS for y in inner)


def _titled(order: list[Node]) -> set[Node]:
    """The nodes that hold an <h1>, itself included. order: parents first."""
    found: set[Node] = set()
    for node in reversed(order):
        if node.chars and (node.tag == "h1" or node in found):
            found.add(node)
            if node.up is not None:
                found.add(node.up)
    return found


def main_nodes(root: Node) -> tuple[list[Node], float]:
    """Nodes whose text is the main text, in page order, and the density threshold."""
    order = measure(root)
    if not root.chars:
        return [], 0.0
    best = max(order, key=lambda n: (density_sum(n), n.tag in ("article", "main")))
    titled = _titled(order)
    while True:  # where one container of the node holds the title and its text, the others are beside it
        inner = [x for x in best.items if isinstance(x, Node) and not x.junk and x in titled]
        if len(inner) != 1 or inner[0].tag in TEXTS or not density_sum(inner[0]):
            break
        best = inner[0]
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    threshold = min(n.density for n in path if n.chars)
    found = [best]
    for node, up in zip(path, path[1:], strict=False):
        beside = [x for x in up.items if isinstance(x, Node) and not x.junk and x.chars]
        i = next(k for k, x in enumerate(beside) if x is node)
        found = [x for x in beside[:i] if _heading(x) or _beside(x, threshold)] + found
        found += [x for x in beside[i + 1 :] if not _heading(x) and _beside(x, threshold)]
    return found, threshold


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks of a node, without furniture and link lists."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.junk or x is not node and x.tag in BLOCK and x.density < threshold and 2 * x.link_chars > x.chars:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    nodes, threshold = main_nodes(root)
    return "\n".join(b for n in nodes for b in blocks(n, threshold))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but the html, and `text`: each page's main text."""
    keep = [c for c in pages.columns if c not in (html, "text")]
    return map_lists(pages.select(*keep, html), lambda h: {"text": [main_text(x) for x in h]}, "text string", keep=keep)
