"""Main text of web pages by composite text density.

Every page becomes a small DOM. For each node the characters per tag, adjusted
for link characters and link tags, give its composite density; a node's density
sum adds those of its children. The node of the greatest sum is the anchor; the
smallest density and the smallest sum on the path from body to it are the
thresholds. Each node at or above the first contributes the subtree of greatest
sum below it, if that is a paragraph or heading or its sum is at or above the
second: a footer or advert of one bare line is dense, but sums up to little.

Defined cases: null or empty html, or a page without text, gives an empty text;
unclosed and stray tags are repaired the way browsers do for paragraphs, list
items and table cells; repeated page rows give repeated results; of equal sums
the outermost, then the first node wins. Other columns are left out.
"""

from __future__ import annotations

import html as htmllib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom semantics svg g path use circle ellipse line polyline polygon rect defs tspan".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
P_SCOPE = frozenset("html body table td th caption button object article section div main aside li".split())
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KIND_SCOPE = frozenset("ul ol dl table select menu body html".split())
# Page furniture by element, role and whole class or id.
DROPPED = frozenset("nav footer aside form button select menu dialog object embed canvas audio video head label fieldset template".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
FURNITURE = re.compile(
    r"(?:(?:site|main|top|bottom|left|right|primary|secondary|global)[_-])?"
    r"(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|sidebar|widget|footer|header|masthead|breadcrumbs?"
    r"|cookies?|consent|notice|newsletter|subscribe|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|related|popup|modal|overlay|login|signup|pagination|toolbar)"
    r"(?:[_-](?:wrapper|wrap|container|box|bar|area|list|links|buttons|left|right|top|bottom|\d+))?",
    re.I,
)
# Elements that hold a paragraph or heading; of others, a short one may be dense by having no tags at all.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
NAMED = "named"  # by class or id: dropped unless it holds the page's content
KEPT = frozenset("html body article main".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "kids", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "best_node", "parent")

    def __init__(self, tag, parent, dropped):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.kids = []  # nodes and strings in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0


def _furniture(tag: str, attrs: str, inside_article: bool) -> bool | str:
    named: bool | str = False
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attrs or attrs.isspace():
        return False
    for m in ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            value = m[2] or m[3] or m[4] or ""
            if name == "role":
                if value.strip().lower() in ROLES:
                    return True
            elif tag not in KEPT and any(FURNITURE.fullmatch(x) for x in value.split()):
                named = NAMED
        elif name == "hidden" and tag not in KEPT:
            return True
    return named


def _spare(root: Node) -> None:
    """Of nodes that are furniture by name, keep those that hold an article or main element or, on pages without one, more than half of the text: density decides on them."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if not isinstance(k, str) and k.dropped is not True]
    held = {}
    for x in reversed(order):
        chars, content = 0, False
        for k in x.kids:
            if isinstance(k, str):
                chars += len(" ".join(k.split()))
            elif k.dropped is not True:
                chars, content = chars + held[id(k)][0], content or held[id(k)][1]
        held[id(x)] = chars, content or (chars > 0 and x.tag in ("article", "main"))
    most, marked = held[id(root)]
    for x in order:
        if x.dropped and (held[id(x)][1] or (not marked and 2 * held[id(x)][0] > most)):
            x.dropped = False


def parse(page: str) -> Node:
    """The page's DOM under a root node; furniture is marked as dropped."""
    root = Node("html", None, False)
    stack, articles, named = [root], 0, False
    at, end, lower = 0, len(page), None

    def pop_to(k):
        nonlocal articles
        for x in stack[k:]:
            articles -= x.tag in ("article", "main")
        del stack[k:]

    while at < end:
        open_at, m = page.find("<", at), None
        while open_at >= 0 and not (m := TOKEN.match(page, open_at)):
            open_at = page.find("<", open_at + 1)
        text = page[at:open_at] if m else page[at:]
        if text:
            stack[-1].kids.append(htmllib.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower() if page.isascii() else re.sub(r"[A-Z]+", lambda x: x[0].lower(), page)
            close = lower.find("</" + tag, at)
            if close < 0:
                break
            at = lower.find(">", close) + 1 or end
            continue
        if tag in ("html", "body") or tag == "head":
            if tag == "body" and not any(x.tag == "body" for x in stack):
                pop_to(1)
            elif tag != "head":
                continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in P_SCOPE:
                    break
        if tag in SAME_KIND:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME_KIND[tag]:
                    pop_to(k)
                    break
                if stack[k].tag in KIND_SCOPE:
                    break
        parent = stack[-1]
        node = Node(tag, parent, _furniture(tag, m[3], articles > 0))
        parent.kids.append(node)
        named = named or node.dropped is NAMED
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            articles += tag in ("article", "main")
    if named:
        _spare(root)
    return root


def _order(root: Node) -> list[Node]:
    """Kept nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.dropped]
    return out


def weigh(nodes: list[Node], body: Node) -> None:
    """Composite density, density sum, and the best node below, for each node.

    Links and blocks count as tags; formatting and void elements pass what they
    hold on to the node around them, so that bold type or a line break doesn't
    thin out the paragraph that it stands in.
    """
    seen_through = [(x.tag in INLINE and x.tag != "a") or x.tag in VOID for x in nodes]
    for x, through in zip(reversed(nodes), reversed(seen_through), strict=True):
        x.chars += sum(len(" ".join(k.split())) for k in x.kids if isinstance(k, str))
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
        if x is not body:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags + (not through)
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags
        x.total, x.best_node = 0.0, None
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for x in nodes:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, x.link_tags
        base = math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
        x.density = c / t * math.log(c / max(1, lc) * t / max(1, lt) + 1.0) / math.log(base + 1.0) if c else 0.0
    for x, through in zip(reversed(nodes), reversed(seen_through), strict=True):
        if not through:
            x.total = x.total or x.density  # a leaf's sum is its own density
            if x.best_node is None or x.total >= x.best:
                x.best, x.best_node = x.total, x
        if x is not body:
            p = x.parent
            p.total += x.total if through else x.density
            if x.best_node is not None and (p.best_node is None or x.best >= p.best):  # page order is reversed: the first of equals wins
                p.best, p.best_node = x.best, x.best_node


def _text(x: Node, parts: list) -> None:
    todo = [x]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            parts.append(k)
        elif k is None:
            parts.append(None)
        elif not k.dropped:
            block = k.tag not in INLINE
            if block:
                parts.append(None)
                todo.append(None)
            todo += reversed(k.kids)


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    body = next((k for k in root.kids if not isinstance(k, str) and k.tag == "body"), root)
    nodes = _order(body)
    weigh(nodes, body)
    if not body.chars:
        return ""
    top = body.best_node
    threshold, least, x = top.density, top.total, top
    while x is not body:
        x = x.parent
        threshold, least = min(threshold, x.density), min(least, x.total)
    content = {id(n.best_node) for n in nodes if n.best_node is not None and n.density >= threshold and n.chars and (n.best >= least or n.best_node.tag in TEXT)}
    parts: list = []
    todo = [body]
    while todo:
        x = todo.pop()
        if id(x) in content:
            _text(x, parts)
            parts.append(None)
        else:
            todo += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.dropped]
    blocks, run = [], []
    for p in [*parts, None]:
        if p is None:
            if run and (b := " ".join("".join(run).split())):
                blocks.append(b)
            run = []
        else:
            run.append(p)
    return " ".join(blocks)


def _batches(batches):
    for b in batches:
        found = [extract(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page row; one narrow pass, no shuffle."""
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(_batches, SCHEMA)
