"""Main text of HTML pages by tree scoring.

A tolerant reader turns a page into a tree of containers and blocks of text. Each paragraph gives its parent
points (one, one per comma, one per hundred characters up to three), its grandparent half, and the ancestors
above a falling share; names of classes and ids that speak for or against content add to a container. Scores are
discounted by link density. The best container is kept whole, with those siblings that score near it or are
paragraphs of prose themselves; what holds menus, headers, footers, sidebars, notices, adverts, forms or
comments is left out first.

A page is a small unit, read by one task in time that grows with its length: tags that are open are counted by name,
so an end tag without its start costs nothing, and lengths of texts are passed up the tree once, at the end.

Defined results: null or empty html, or html without text, gives an empty text. Unclosed and crossed tags are
read as browsers do for paragraphs and list items; an end tag without its start is passed over. A page whose
every block is left out, or whose best container is empty, gives all its text that is not left out. Repeated
pages get a row each. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACES = re.compile(r"\s+")
NBSP = "\xa0"

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
DROP = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "svg", "canvas", "object", "audio", "video", "map", "dialog", "menu", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "frame"}
BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
} | DROP
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "pre", "td", "blockquote", "li", "dd"}
#: An open tag of the first closes one of the second, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

AGAINST = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner|promo\w*|sponsor\w*|menu\w*|nav\w*|breadcrumbs?|header|masthead|foot\w*|side|sidebar\w*|aside|widget\w*|related|recommend\w*|share|sharing|social|"
    r"cookies?\w*|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+|signup|login|comments?|commentlist|disqus\w*|respond|replies|reply|discussion|pagination|pager|copyright|legal|toolbar|tags?|skip\w*|hidden|form|search\w*|toc)(?:$|[\s_-])",
    re.I,
)
FOR = re.compile(r"article|body|content|entry|main|post|story|text|blog|column", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "form", "menu", "menubar", "alert"}


class Node:
    __slots__ = ("tag", "parent", "drop", "score", "chars", "linked", "bonus", "article")

    def __init__(self, tag, parent, drop, bonus):
        self.tag, self.parent, self.drop, self.bonus = tag, parent, drop, bonus
        self.article = tag == "article" or parent is not None and parent.article
        self.score = self.chars = self.linked = 0.0


def unwanted(tag: str, attrs: str, node: Node) -> tuple[bool, float]:
    """Whether a container is left out, and what its names add to its score."""
    if not attrs or attrs.isspace():
        return tag in DROP or tag == "header" and not node.article, 25.0 if tag in ("article", "main") else 0.0
    bonus = 25.0 if tag in ("article", "main") else 0.0
    drop = tag in DROP or tag == "header" and not node.article
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            drop = True
        elif name == "role" and value.lower() in ROLES:
            drop = True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if AGAINST.search(value):
                drop = True
            elif FOR.search(value):
                bonus += 25.0
    return drop, bonus


def blocks_of(page: str) -> list[tuple[Node, str]]:
    """The page's blocks in order: the innermost block element and its text, spaces collapsed; links are counted."""
    node = Node("#root", None, False, 0.0)
    nodes = [node]
    open_tags: Counter[str] = Counter()
    out: list[tuple[Node, str]] = []
    text: list[str] = []
    linked = depth_a = 0
    pos, n = 0, len(page)

    def flush():
        nonlocal linked
        if text:
            joined = SPACES.sub(" ", "".join(text)).strip()
            if joined and not node.drop:
                out.append((node, joined))
                node.chars += len(joined)
                node.linked += min(linked, len(joined))
            text.clear()
        linked = 0

    def said(piece: str):
        nonlocal linked
        if piece and not node.drop:
            piece = html.unescape(piece)
            text.append(piece)
            if depth_a:
                linked += len(piece.strip())

    def back_to(above: Node):
        """Close all up to an ancestor, which stays open."""
        nonlocal node
        while node is not above:
            open_tags[node.tag] -= 1
            node = node.parent

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            said(page[pos:])
            break
        if lt > pos:
            said(page[pos:lt])
        m = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if m is None:  # a bare "<", or a tag cut off by the end of the page
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]) and page.find(">", lt) < 0:
                break
            said("<")
            pos = lt + 1
            continue
        pos = m.end()
        if not m.lastindex or m.group(2) is None:
            continue
        tag, attrs = m.group(2).lower(), m.group(3) or ""
        if m.group(1):
            if tag == "a":
                depth_a = max(0, depth_a - 1)
            elif tag == "br":
                text.append(" ")
            elif tag in BLOCK:
                flush()
                if open_tags[tag]:
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    back_to(up.parent)
                    depth_a = 0
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag == "a":
            depth_a = 1
            continue
        if tag not in BLOCK or attrs.endswith("/") and tag not in BLOCK:
            continue
        flush()
        up = node
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            if any(open_tags[t] for t in own):
                while up.tag not in stop and up.tag not in own:
                    up = up.parent
                if up.tag in own:
                    up = up.parent
                    while tag == "tr" and up.tag in own:
                        up = up.parent
                    back_to(up)
        elif open_tags["p"]:  # a block ends an open paragraph
            while up.tag != "p":
                up = up.parent
            back_to(up.parent)
        elif tag in HEADING and node.tag in HEADING:
            back_to(node.parent)
        drop, bonus = unwanted(tag, attrs, node)
        node = Node(tag, node, drop or node.drop, bonus)
        nodes.append(node)
        open_tags[tag] += 1
        depth_a = 0
    flush()
    for below in reversed(nodes[1:]):  # a node comes after its parent
        below.parent.chars += below.chars
        below.parent.linked += below.linked
    return out


def score(blocks: list[tuple[Node, str]]) -> dict[Node, float]:
    """Points of the containers: paragraphs' points passed up, plus names, discounted by link density."""
    seen: dict[Node, None] = {}
    for node, text in blocks:
        if len(text) < 25 or node.tag in HEADING:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        up = node.parent if node.tag in PROSE and node.parent is not None else node
        level = 0
        while up is not None and level < 5:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            seen[up] = None
            up, level = up.parent, level + 1
    return {node: (node.score + node.bonus) * (1 - node.linked / max(node.chars, 1)) for node in seen}


def main_text(page: str | None) -> str:
    """The page's main text: blocks in order, joined by one space."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    scores = score(blocks)
    if not scores:
        return " ".join(t for _, t in blocks)
    best = max(scores, key=scores.get)  # of equals, the first
    least = max(10.0, 0.2 * scores[best])
    kept: dict[Node, bool] = {}

    def keep(node: Node, text: str) -> bool:
        if node is best:
            return True
        path = []
        up = node
        while up is not None and up is not best and up.parent is not best.parent and up not in kept:
            path.append(up)
            up = up.parent
        if up is None:
            ok = False
        elif up in kept:
            ok = kept[up]
        elif up is best:
            ok = True
        else:  # a sibling of the best
            density = up.linked / max(up.chars, 1)
            ok = scores.get(up, 0.0) >= least or up.tag in HEADING and density < 0.5 or up.tag in PROSE and (up.chars > 80 and density < 0.25 or up.linked == 0 and text[-1:] in ".!?")
            kept[up] = ok
        for x in path:
            kept[x] = ok
        return ok

    return " ".join(t for node, t in blocks if keep(node, t))


def extract_batches(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, main text and its code points."""
    kind = dict(pages.dtypes)[id_col]
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(extract_batches, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)


def op5_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
