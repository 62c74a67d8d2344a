"""HTML extraction by a tree-structured graphical model.

Block elements of a page are the nodes of a tree. Each node is content or not; a parent-child potential couples every
node with its parent, and a node potential weighs what is seen of it: its tag, words of its class and id, the share
of its characters in links, its length. Sum-product messages pass from the leaves to the root and back, and give each
node's marginal. Potentials are counted, with add-one smoothing, from labelled pages that `labelled_pages` composes by
rule from many layouts. Text of nodes that are likelier content than not becomes the main text.

What is never prose (comments, head, script, style, form controls) is no part of the tree. Character references are
decoded, white space inside a block (a line break counts as such) becomes one space, blocks are trimmed and joined by a line
feed in page order; empty ones vanish. Attributes are told by their names: what a value says of hidden things drops nothing. Defined
results: null or empty html, or a page without content, gives empty text; unclosed and stray tags are closed as
browsers do or ignored; an unclosed tag, comment or script runs to the end; a page costs time in proportion to its length.
Pages are independent of each other: repeated rows give repeated results, other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: which elements have no content, whose content is not prose, which stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript select option datalist textarea button svg math iframe object canvas audio video title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag of the first closes open elements of the second, up to the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role attributes that tell what a block is for.
KEYWORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager skip",
    "frame": "header masthead footer foot colophon topbar bottom banner contentinfo copyright legal",
    "side": "sidebar aside side widget related recommended trending popular complementary more tags share social",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast disclaimer subscribe newsletter signup promo",
    "advert": "ad ads advert advertisement advertising sponsor sponsored adsense promo promoted banner-ad",
    "form": "form search login register",
    "comment": "comment comments reply replies discussion disqus respond",
    "main": "article content main post entry story body text prose",
}
_KEYWORD = {w: kind for kind, ws in KEYWORDS.items() for w in ws.split()}
#: A tag: its attributes' values may be quoted and then hold anything; a quote that nothing closes is a character like others.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+)?+")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    kinds: frozenset[str] = frozenset()
    chars: int = 0
    link_chars: int = 0
    label: int = -1


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _kinds(attributes: str) -> frozenset[str]:
    """Kinds named by the values of class, id and role; the first attribute of a name counts."""
    found, seen = set(), set()
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role") and name not in seen:
            seen.add(name)
            found.update(_KEYWORD[w] for x in _SPLIT.split(m[2] or m[3] or m[4] or "") if (w := x.lower()) in _KEYWORD)
    return frozenset(found)


class _Open:
    """Open elements, with the places of each tag and of blocks, so that none of the questions asked of them walks the
    stack: a page costs time in proportion to its length, however it nests."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # the element and the block node it belongs to
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tag: str) -> int:
        """The place of the innermost open element of this tag, 0 if there is none."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else 0

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        return tag


def _tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes) of "text", "raw" text, "start", "void" (a start tag that closes itself) and "end". What
    nothing closes (a tag, a comment, a script) runs to the end of the page."""
    at, n = 0, len(text)
    while at < n:
        cut = text.find("<", at)
        if cut < 0:
            yield "text", text[at:], ""
            return
        if cut > at:
            yield "text", text[at:cut], ""
        after = text[cut + 1 : cut + 2]
        if after in ("!", "?") or after == "/" and not text[cut + 2 : cut + 3].isalpha():
            opener, closer = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if text.startswith(o, cut)), ("<", ">"))
            end = text.find(closer, cut + len(opener))
            if opener == "<![CDATA[":
                yield "raw", text[cut + 9 : n if end < 0 else end], ""
            if end < 0:
                return
            at = end + len(closer)
        elif after == "/" or after.isascii() and after.isalpha():
            m = _TAG.match(text, cut)
            if m is None:
                return
            tag, at = m[2].lower(), m.end()
            if m[1]:
                yield "end", tag, ""
            else:
                yield ("void" if m[3].endswith("/") or tag in VOID else "start"), tag, m[3]
                if tag in RAW:
                    close = _close(tag).search(text, at)
                    if close is None:
                        return
                    at = close.end()
        else:
            yield "text", "<", ""
            at = cut + 1


@cache
def _close(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


def parse(source: str | None) -> Page:
    """The tree of block elements and, in page order, the blocks of text with the node that owns them."""
    page, open_ = Page(nodes=[Node("#root", -1)]), _Open()
    pieces: list[str] = []
    owner, links, hidden = 0, 0, 0

    def flush() -> None:
        if pieces:
            joined = " ".join("".join(pieces).split())
            pieces.clear()
            if joined:
                page.nodes[owner].chars += len(joined)
                page.blocks.append((owner, joined))

    def pop_to(index: int) -> None:
        nonlocal hidden, links, owner
        while len(open_.stack) > index:
            tag = open_.pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag in BLOCK:
                flush()
                owner = open_.stack[-1][1]

    for kind, tag, attributes in _tokens(source or ""):
        if kind in ("text", "raw"):
            if not hidden:
                # References are decoded in each piece of text, so that markup between two pieces joins no reference.
                pieces.append(html_lib.unescape(tag) if kind == "text" and "&" in tag else tag)
                if links:
                    page.nodes[owner].link_chars += len(tag)
            continue
        if kind == "end":
            at = open_.last(tag)
            if at and (tag in BLOCK or at > open_.last_block()):
                pop_to(at)
            elif tag == "p":
                flush()
            elif tag == "br" and not hidden:
                pieces.append(" ")
            continue
        if tag in RAW:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not hidden:
                pieces.append(" ")
            continue
        if tag in BLOCK:
            if tag != "html" and (at := open_.last("head")):
                pop_to(at)
            if (at := open_.last_block()) and open_.stack[at][0] == "p":
                pop_to(at)
        if tag in IMPLIED:
            closes, until = IMPLIED[tag]
            at = max(map(open_.last, closes))
            if at > max(map(open_.last, until)):
                pop_to(at)
        if tag in BLOCK:
            flush()
            page.nodes.append(Node(tag, open_.stack[-1][1], _kinds(attributes) if attributes else frozenset()))
            owner = len(page.nodes) - 1
            open_.push(tag, owner)
        elif kind == "start":
            open_.push(tag, open_.stack[-1][1])
            hidden += tag in HIDDEN
            links += tag == "a"
    flush()
    return page


def evidence(node: Node) -> list[str]:
    """What the model sees of a node."""
    density = node.link_chars / node.chars if node.chars else 0.0
    return [f"tag={node.tag}", *(f"kind={k}" for k in node.kinds), f"links={0 if density < 0.2 else 1 if density < 0.6 else 2}" if node.chars else "empty", f"size={min(6, int(math.log2(node.chars + 1)) // 2)}"]


@dataclass
class Model:
    node: dict[str, float]  # log-odds of content for each thing seen
    edge: tuple[tuple[float, float], tuple[float, float]]  # share of child states by the parent's state
    root: float

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability of being content: messages to the root, then back."""
        nodes = page.nodes
        n = len(nodes)
        own = []
        for x in nodes:
            odds = max(-30.0, min(30.0, sum(self.node.get(e, 0.0) for e in evidence(x))))
            own.append((1.0, math.exp(odds)))
        (e00, e01), (e10, e11) = self.edge
        up = list(own)
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            a, b = up[i]
            m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
            s = m0 + m1
            sent[i] = (m0 / s, m1 / s)
            p = nodes[i].parent
            x, y = up[p][0] * sent[i][0], up[p][1] * sent[i][1]
            up[p] = (x / (x + y), y / (x + y))
        out = [0.0] * n
        down = [(1 - self.root, self.root)] * n
        for i in range(n):
            if i:
                p = nodes[i].parent
                q0, q1 = down[p][0] * up[p][0] / max(sent[i][0], 1e-300), down[p][1] * up[p][1] / max(sent[i][1], 1e-300)
                d0, d1 = q0 * e00 + q1 * e10, q0 * e01 + q1 * e11
                s = d0 + d1
                down[i] = (d0 / s, d1 / s)
            a, b = down[i][0] * up[i][0], down[i][1] * up[i][1]
            out[i] = b / (a + b)
        return out


_SYLLABLES = "ta ne ri mo lu ka se vi do pa".split()


def labelled_pages(count: int = 400, seed: int = 7) -> Iterator[tuple[str, list[int]]]:
    """Pages composed by rule, with the label (1 content, 0 not) of every block element in page order."""
    rng = random.Random(seed)
    prose = lambda lo, hi: " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def element(tag: str, label: int, inside: str, labels: list[int], attribute: str = "") -> tuple[str, list[int]]:
        return f"<{tag}{attribute}>{inside}</{tag}>", [label, *labels]

    def many(parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        return "".join(p[0] for p in parts), [x for p in parts for x in p[1]]

    def paragraph(label: int, lo: int = 4, hi: int = 90) -> tuple[str, list[int]]:
        body = prose(lo, hi)
        if rng.random() < 0.3:
            body = f'{body} <a href="/x">{prose(1, 3)}</a> {prose(1, 8)}'
        return element(rng.choice(["p"] * 8 + ["blockquote", "pre"]), label, body, [])

    def menu(attribute: str = "", tag: str = "nav") -> tuple[str, list[int]]:
        items = many([element("li", 0, f'<a href="/{i}">{prose(1, 2)}</a>', []) for i in range(rng.randint(2, 8))])
        inner = element("ul", 0, *items)
        return element(tag, 0, *inner, attribute)

    def boiler(kind: str) -> tuple[str, list[int]]:
        named = lambda *ws: f' {rng.choice(["class", "id"])}="{rng.choice(ws)}"'
        if kind == "menu":
            return menu() if rng.random() < 0.6 else menu(named("menu", "main-nav", "breadcrumbs", "pagination"), "div")
        if kind == "frame":
            tag = rng.choice(["header", "footer", "footer"])
            return element(tag, 0, prose(2, 12), [], "" if rng.random() < 0.6 else named(f"site-{tag}", tag)) if rng.random() < 0.7 else element("div", 0, *paragraph(0, 2, 12), named("page-footer", "site-header", "masthead", "copyright"))
        if kind == "side":
            return element("aside", 0, *many([paragraph(0, 2, 30) for _ in range(rng.randint(1, 3))]), named("sidebar", "related", "x")) if rng.random() < 0.6 else element("div", 0, *many([element("h3", 0, prose(1, 3), []), menu("", "div")]), named("sidebar", "related-posts", "widget", "share"))
        if kind == "form":
            return element("form", 0, f"<label>{prose(1, 3)}</label><input><button>{prose(1, 1)}</button>", [])
        if kind == "comment":
            return element(rng.choice(["section", "div"]), 0, *many([element("div", 0, *paragraph(0, 3, 50), named("comment", "x")) for _ in range(rng.randint(1, 4))]), named("comments", "comment-list", "discussion"))
        if kind == "notice":
            return element("div", 0, *(paragraph(0, 3, 30) if rng.random() < 0.5 else (prose(3, 30), [])), named("cookie-notice", "notice", "newsletter", "consent-banner", "popup"))
        return element("div", 0, *(paragraph(0, 3, 30) if rng.random() < 0.5 else (prose(3, 40), [])), named("ad", "advert", "sponsored", "ads"))

    kinds = ["menu", "frame", "side", "form", "comment", "notice", "advert"]
    for _ in range(count):
        inside = [element("h1", 1, prose(2, 10), [])]
        for _ in range(rng.randint(1, 9)):
            x = rng.random()
            if x < 0.75:
                inside.append(paragraph(1))
            elif x < 0.82:
                inside.append(element(rng.choice(["h2", "h3"]), 1, prose(1, 7), []))
            elif x < 0.88:
                inside.append(element(rng.choice(["ul", "ol"]), 1, *many([element("li", 1, prose(1, 20), []) for _ in range(rng.randint(1, 5))])))
            elif x < 0.91:
                inside.append(element("table", 1, *many([element("tr", 1, *many([element("td", 1, prose(1, 5), []) for _ in range(2)])) for _ in range(rng.randint(1, 3))])))
            elif x < 0.94:
                inside.append(element(rng.choice(["div", "section", "figure"]), 1, *many([paragraph(1) for _ in range(rng.randint(1, 3))])))
            else:
                inside.append(boiler(rng.choice(kinds)))
        tag, attribute = rng.choice([("article", "")] * 4 + [("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"')])
        main = element(tag, 1, *many(inside), attribute)
        if rng.random() < 0.3:
            main = element(rng.choice(["div", "main"]), 1, *main, rng.choice(["", ' id="main"']))
        around = [boiler(k) for k in rng.choices(kinds, k=rng.randint(1, 4))], [boiler(k) for k in rng.choices(kinds, k=rng.randint(1, 4))]
        page = element("html", 0, *element("body", 0, *many([*around[0], main, *around[1]])))
        yield page[0], page[1]


@cache
def trained() -> Model:
    """Potentials counted from the labelled pages; the same in every process."""
    seen = (Counter(), Counter())
    steps = [[1.0, 1.0], [1.0, 1.0]]
    totals = [0, 0]
    for source, labels in labelled_pages():
        page = parse(source)
        if len(page.nodes) != len(labels) + 1:
            raise ValueError("labels and tree differ")
        given = [0, *labels]
        for node, label in zip(page.nodes, given, strict=True):
            totals[label] += 1
            seen[label].update(evidence(node))
            if node.parent >= 0:
                steps[given[node.parent]][label] += 1
    odds = {e: math.log((seen[1][e] + 1) / (totals[1] + 2)) - math.log((seen[0][e] + 1) / (totals[0] + 2)) for e in seen[0].keys() | seen[1].keys()}
    shares = tuple(tuple(x / sum(row) for x in row) for row in steps)
    return Model(odds, shares, 0.01)


def main_text(source: str | None, model: Model) -> str:
    page = parse(source)
    if not page.blocks:
        return ""
    p = model.marginals(page)
    return "\n".join(text for node, text in page.blocks if p[node] > 0.5)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0).to_pylist(), "url": batch.column(1).to_pylist(), "text": texts, "n_chars": [len(t) for t in texts]}, schema=schema)

    return df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
