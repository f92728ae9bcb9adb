"""Operator 9: main-text extraction from HTML by tree scoring.

A page is read once into a tree of elements and a list of text blocks. Paragraphs pass points to their
ancestors: 1, one for each comma, one for each 100 characters (three at most); the parent takes them
whole, the grandparent half, each further ancestor a third of the level before. An element's points are discounted by its
link density. The best container is kept, or the article or main element around it, with those of its
siblings that carry text of their own.

Boilerplate is left out wherever it stands: by element (navigation, header, footer, aside, forms,
scripts, styles), by ARIA role, by a hidden attribute, or by a word of class or id (adverts, notices,
sidebars, comments ...). An element that holds the page's article is never left out for its class.
Headings in an article's own header are kept.

Text: character references are decoded, white space inside a block becomes one space, blocks
are joined by one line feed in page order. Nothing else is dropped or capped.

Defined cases: null or empty html and pages without text give an empty string; unclosed and stray tags are
accepted as browsers do (a new paragraph or list item ends an open one); repeated rows are
repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by role, and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split()
)
DROP = frozenset("head nav footer aside form button select option menu dialog fieldset header".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner promo promotion promoted sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall "
    "sidebar side sidenav widget widgets menu menus nav navbar navigation topbar breadcrumb breadcrumbs pagination pager "
    "header masthead footer foot copyright legal disclaimer comment comments commentlist disqus reply replies respond discussion "
    "share sharing social related recommended recommendations more-stories toolbar tags skip alert form search".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main body html blockquote nav aside footer header form td th".split())
CONTENT = frozenset(["article", "main"])
HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
PARAGRAPH = HEADING | frozenset("p pre blockquote li ul ol dl dd dt table figure figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_WORD = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "out", "furniture", "content", "chars", "links", "points", "held")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.out = self.furniture = self.content = False
        self.chars = self.links = 0
        self.points = 0.0
        self.held = False  # left out, by itself or an ancestor


def _marks(node: Node, attrs: str) -> None:
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if not FURNITURE.isdisjoint(_WORD.split(value)) or not FURNITURE.isdisjoint(value.split()):
                node.furniture = True
        elif name == "role":
            if value in ROLES:
                node.furniture = True
            elif value in CONTENT:
                node.content = True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            node.out = True


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements in page order, and blocks (element, text, characters inside links)."""
    root = Node("html", None)
    nodes, blocks, stack = [root], [], [root]
    pieces: list[str] = []
    linked: list[str] = []
    depth_a, at, n = 0, 0, len(html)
    low = None

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                blocks.append((owner(), text, len(" ".join(unescape("".join(linked)).split())) if linked else 0))
            pieces.clear()
            linked.clear()

    def owner() -> Node:
        for x in reversed(stack):
            if x.tag not in INLINE:
                return x
        return root

    find = _TOKEN.search
    while at < n:
        m = find(html, at)
        if m is None:
            pieces.append(html[at:])
            if depth_a:
                linked.append(html[at:])
            break
        if m.start() > at:
            text = html[at : m.start()]
            pieces.append(text)
            if depth_a:
                linked.append(text)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                depth_a = max(0, depth_a - 1)
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end tag does not close blocks
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                pieces.append(" " if tag == "br" else "")
                continue
            if tag == "a":
                depth_a += 1
            node = Node(tag, stack[-1])
            if m["attrs"]:
                _marks(node, m["attrs"])
                if node.out:  # a hidden stretch inside a block stands alone, to be left out
                    flush()
                    node.tag = "div"
            if tag != "a" or node.out:
                stack.append(node)
                nodes.append(node)
            continue
        flush()
        if tag in RAW:
            if m["attrs"].endswith("/") and tag in ("svg", "math"):
                continue
            low = html.lower() if low is None else low
            end = low.find("</" + tag, at)
            if end < 0:
                break
            end = html.find(">", end)
            at = n if end < 0 else end + 1
            continue
        # implied end tags
        closes = CLOSED_BY.get(tag)
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t == "p" or closes and t in closes:
                del stack[i:]
                depth_a = 0
                if not closes or t != "p":
                    break
            elif t in SCOPE:
                break
        if tag == "html":
            continue
        node = Node(tag, stack[-1])
        nodes.append(node)
        if m["attrs"]:
            _marks(node, m["attrs"])
        if tag in CONTENT:
            node.content = True
        if tag in VOID or m["attrs"].endswith("/") and tag not in SCOPE and tag != "p":
            continue
        stack.append(node)
    flush()
    return nodes, blocks


def _hold(nodes: list[Node], by_class: bool) -> None:
    """Marks what is left out."""
    holds: set[int] = set()  # elements that hold article or main outside of furniture's own articles
    for x in nodes:
        if x.content and not x.furniture:
            up = x.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for x in nodes:
        if x.parent is None:
            continue
        if x.parent.held:
            x.held = True
        elif x.out or x.tag in DROP:
            x.held = x.out or id(x) not in holds
            if x.tag == "header" and x.held and not x.out and _inside(x, "content"):
                x.held, x.points = False, -1.0  # only its headings count
        elif x.furniture and by_class:
            x.held = x.tag not in ("html", "body", "main") and id(x) not in holds
        if not x.held and x.parent.points < 0 and x.parent.tag != "html":
            if x.tag in HEADING:
                x.points = 0.0
            else:
                x.points = -1.0


def _inside(x: Node, what: str) -> bool:
    up = x.parent
    while up is not None:
        if getattr(up, what):
            return True
        up = up.parent
    return False


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by line feeds."""
    if not html:
        return ""
    nodes, blocks = parse(html)
    for by_class in (True, False):
        for x in nodes:
            x.held, x.points, x.chars, x.links = False, 0.0, 0, 0
        _hold(nodes, by_class)
        live = [b for b in blocks if not b[0].held and b[0].points >= 0]
        if live or not blocks:
            break
    if not live:
        return ""
    for x, text, linked in live:
        points = 1.0 + text.count(",") + min(len(text) / 100, 3.0)
        points *= 1 - min(1.0, linked / len(text))
        share, up = 1.0, x if x.tag not in PARAGRAPH or x.parent is None else x.parent
        level = 0
        while up is not None:
            up.points += points * share
            up.chars += len(text)
            up.links += linked
            level += 1
            share = 0.5 if level == 1 else share / 3
            up = up.parent
        if x.tag in PARAGRAPH:
            x.chars += len(text)
            x.links += linked

    def score(x: Node) -> float:
        return x.points * (1 - x.links / x.chars) if x.chars else 0.0

    seen, hosts = set(), []
    for x, _, _ in live:
        up = x if x.tag not in PARAGRAPH or x.parent is None else x.parent
        while up is not None and id(up) not in seen:
            seen.add(id(up))
            hosts.append(up)
            up = up.parent
    best = max(hosts, key=score)
    top, up = best, best
    while up is not None:  # the article around it, if there is one
        if up.content:
            top = up
        up = up.parent
    kept = {id(top)}
    if not top.content and top.parent is not None:
        least = max(2.0, 0.2 * score(best))
        for x in nodes:
            if x.parent is top.parent and x is not top and not x.held and x.chars and x.links / x.chars < 0.34:
                if score(x) >= least or x.tag in PARAGRAPH:
                    kept.add(id(x))
    out = []
    for x, text, _ in live:
        up = x
        while up is not None:
            if id(up) in kept:
                out.append(text)
                break
            up = up.parent
    return "\n".join(out)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"]
            )

    own = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return own.mapInArrow(run, "key long, url string, text string, n_chars long")
