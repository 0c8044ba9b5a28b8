"""Main text of HTML pages by a minimum cut between content and boilerplate blocks.

A page becomes blocks of text. A linear classifier's cost of calling a block boilerplate is its capacity from the source, that
of calling it content its capacity to the sink; neighbours on the page and in the document tree are tied by capacities
that fall with their distance in the tree. The minimum cut is the cheapest labelling of all blocks together: marks of the page
(article, nav, names of classes) weigh much, and blocks whose own words and links say little go with their neighbours."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .superminhash import chunks

#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe title xmp noembed noframes head".split())
#: Elements whose content is no text, but markup or a notice: they end with their parent at the latest, some with any block.
HIDDEN = frozenset("template svg audio video foreignobject title".split())
ENDED_BY_BLOCK = frozenset("svg title".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead tr ul""".split()
)
#: Opening one of these ends an open one of those, unless an element of the third group is between them.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
        "tbody": ("tr td th thead tbody tfoot", "table")}
ENDS_P = BLOCK - {"body", "html", "caption", "dd", "dt", "legend", "li", "optgroup", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: End tags of other elements have no effect beyond these.
CELLS = ("td", "th", "caption")
TABLE = frozenset("table caption tbody td tfoot th thead tr body html".split())
FURNITURE = frozenset("nav aside footer form dialog menu search fieldset".split())
#: Controls stand inside a line, and are furniture.
CONTROLS = frozenset("button select label datalist output meter progress".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist".split())
#: Words of class and id names that stand for what is no part of the article, for what readers say of it, and for the article.
NOT_CONTENT = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside side menu nav navbar
    navigation topnav subnav footer foot masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay
    newsletter subscribe subscription signup share sharing social related recommended recommendations more breadcrumb breadcrumbs pagination
    pager widget widgets login toolbar skip tags taglist hidden copyright legal disclaimer trending popular teaser teasers outbrain taboola
    feedback rating ratings poll survey toc paywall""".split()
)
SAID = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
CONTENT = frozenset("article content post entry story main maincontent body text articlebody postcontent entrycontent prose".split())
#: A name that begins or ends with one of these tells a state of the element, not what it is.
STATE_BEFORE = frozenset("has no not with without is hide show js".split())
STATE_AFTER = frozenset("open closed enabled disabled on off count visible fixed".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_TAG_END = re.compile(r"[\s/]*>")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)" if t != "head" else r"</head(?=[\s/>])|<body(?=[\s/>])", re.I) for t in RAW}

#: The classifier: log odds of content, for a block that says nothing of itself, and what each feature adds.
WEIGHTS = {"bias": -0.6, "furniture": -9.0, "article": 4.5, "outside": -3.0, "links": -3.2, "length": 0.7, "stops": 0.9, "paragraph": 0.7, "heading": 0.5, "list": -0.1, "rights": -2.5}
#: Ties between neighbours: weight at distance 2 (siblings), halved with each two further steps in the tree.
TIE = 0.9
#: On a page without articles, an element named like furniture is none if it holds this share of the text, mostly unlinked;
#: nor is a form of prose.
WHOLE, LINKED = 0.6, 0.3
PLAIN, LAYOUT, READERS = range(3)


@dataclass(eq=False)
class Node:
    tag: str
    depth: int
    parent: Node | None
    number: int
    marked: bool = False  # furniture by its element or role
    unseen: bool = False
    name: int = PLAIN  # what its class or id says
    strong: bool = False  # an article by its element or role, or
    weak: bool = False  # by its class or id
    dropped: bool = False
    mass: int = 0  # characters of its text; of these
    linked: int = 0
    prose: int = 0
    told: int = 0  # in articles
    furniture: bool = False
    article: bool = False


@dataclass
class Block:
    text: str
    node: Node
    linked: int
    paragraph: bool
    heading: bool
    listed: bool


def _named(value: str) -> tuple[int, bool]:
    """What the names of a class or id attribute say: a kind of furniture, and whether some stands for an article."""
    kind, content = PLAIN, False
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not words or words[0] in STATE_BEFORE or len(words) > 1 and words[-1] in STATE_AFTER:
            continue
        if not SAID.isdisjoint(words):
            kind = READERS
        elif not NOT_CONTENT.isdisjoint(words):
            kind = max(kind, LAYOUT)
        elif not CONTENT.isdisjoint(words):
            content = True
    return kind, content


def _node(tag: str, attrs: list[tuple[str, str]], parent: Node | None, number: int) -> Node:
    node = Node(tag, parent.depth + 1 if parent else 0, parent, number)
    node.marked = tag in FURNITURE or tag in CONTROLS
    node.strong = tag in ("article", "main")
    node.dropped = tag in HIDDEN or (parent is not None and parent.dropped)
    for name, value in attrs:
        if name in ("class", "id") and tag not in ("html", "body"):
            kind, content = _named(value)
            if kind == LAYOUT and content and node.strong:
                kind = PLAIN
            node.name, node.weak = max(node.name, kind), node.weak or content
        elif name == "role":
            node.marked |= value.lower() in ROLES
            node.strong |= value.lower() in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            node.unseen = True
    return node


class _Page:
    """Reads a page into nodes and blocks, each character and each open element a bounded number of times."""

    def __init__(self, page: str):
        self.root = Node("#root", 0, None, 0)
        self.nodes, self.stack, self.blocks = [self.root], [self.root], []
        self.where: defaultdict[str, list[int]] = defaultdict(list)  # places on the stack of each tag's open elements
        self.inline: defaultdict[str, list[tuple[int, Node | None]]] = defaultdict(list)  # open elements inside lines
        self.held: list[str] = []
        self.linked = self.in_link = 0
        self._read(page)
        self.flush(True)

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1].dropped:
            self.held.append(piece)
            if self.in_link:
                self.linked += len(piece.strip())

    def flush(self, ends: bool = False) -> None:
        if self.stack[-1].dropped and not ends:
            return
        text = " ".join(html.unescape("".join(self.held)).split())
        if text:
            node = self.stack[-1]
            while node.dropped:
                node = node.parent
            listed, up = False, node
            for _ in range(12):
                listed, up = listed or up.tag == "li", up.parent
                if up is None:
                    break
            heading = node.tag[0] == "h" and node.tag[1:].isdigit()
            block = Block(text, node, min(self.linked, len(text)), node.tag in ("p", "blockquote", "pre"), heading, listed)
            self.blocks.append(block)
            node.mass += len(text)
            node.linked += block.linked
            node.prose += len(text) * (block.paragraph or heading or listed)
        self.held.clear()
        self.linked = 0

    def push(self, node: Node) -> None:
        self.where[node.tag].append(len(self.stack))
        self.stack.append(node)
        self.nodes.append(node)

    def close_to(self, i: int) -> None:
        if not self.stack[i].dropped:
            self.flush(True)
        while len(self.stack) > i:
            self.where[self.stack.pop().tag].pop()

    def top(self, tags: Iterable[str]) -> int:
        """The highest place of an open element with one of these tags, 0 without."""
        return max((self.where[t][-1] for t in tags if self.where[t]), default=0)

    def _read(self, page: str) -> None:
        at, size, last = 0, len(page), page.rfind(">")
        never: set[str] = set()  # raw elements that nothing ends from here on
        while (lt := page.find("<", at)) >= 0:
            self.text(page[at:lt])
            m = _TAG.match(page, lt + 1)
            if m is None:
                after = page[lt + 1 : lt + 2]
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 2)
                    at = size if end < 0 else end + 3
                elif after and after in "!?/":
                    at = page.find(">", lt) + 1 if lt < last else size
                else:
                    self.text("<")
                    at = lt + 1
                continue
            if lt > last:  # a tag that does not end
                return
            at, attrs, empty = m.end(), [], False
            while (end := _TAG_END.match(page, at)) is None:
                x = _ATTR.match(page, at)
                if x is None:  # the page ends inside the tag
                    return
                attrs.append((x[1].lower(), x[2] or x[3] or x[4] or ""))
                at = x.end()
            empty = page[end.end() - 2] == "/"
            at, tag = end.end(), m[2].lower()
            if m[1]:
                self.close(tag)
            elif tag in RAW:
                at = self.raw(tag, page, at, empty, never)
            else:
                self.open(tag, attrs, empty)
        self.text(page[at:])

    def raw(self, tag: str, page: str, at: int, empty: bool, never: set[str]) -> int:
        self.text(" ")
        if empty and tag != "title":
            return at
        end = None if tag in never else _RAW_END[tag].search(page, at)
        if end is not None:
            return end.start() if end[0][1] != "/" else (page.find(">", end.end()) + 1 or len(page))
        never.add(tag)
        if tag == "title":
            self.push(_node(tag, [], self.stack[-1], len(self.nodes)))
        return at if tag in ("title", "head") else len(page)  # any other holds the rest of the page

    def close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1) if not self.stack[-1].dropped else self.in_link
        if tag in BLOCK or tag in HIDDEN:
            i = self.top((tag,))
            if i and (tag in TABLE or tag in HIDDEN or i > self.top(CELLS)):
                self.close_to(i)
            elif tag == "p":
                self.flush()
            return
        if tag == "br":
            self.text(" ")
        opened = self.inline[tag]
        while opened and opened[-1][0] > len(self.stack):  # those whose block has ended
            opened.pop()
        if opened:
            depth, node = opened.pop()
            if node is not None and self.stack[depth - 1] is node:
                self.close_to(depth - 1)

    def open(self, tag: str, attrs: list[tuple[str, str]], empty: bool) -> None:
        top = self.stack[-1]
        if tag in HIDDEN:  # inside a line it is no end of the block
            if not empty and (tag != "foreignobject" or top.dropped):
                self.text(" ")
                self.push(_node(tag, [], top, len(self.nodes)))
        elif tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag != "wbr":
                self.text(" ")
        elif tag in BLOCK:
            while self.stack[-1].tag in ENDED_BY_BLOCK:
                self.where[self.stack.pop().tag].pop()
            self.flush()
            self.in_link = 0 if not self.stack[-1].dropped else self.in_link
            if tag == "hr" or (tag in ("html", "body") and self.where[tag]):
                return
            if tag in ENDS_P and (i := self.top(("p",))) and i > self.top(("td", "th", "li", *CONTROLS, *HIDDEN)):
                self.close_to(i)
            if tag in ENDS:
                ends, bound = ENDS[tag][0].split(), (*ENDS[tag][1].split(), *HIDDEN)
                while (i := self.top(ends)) > self.top(bound):
                    self.close_to(i)
            node = _node(tag, attrs, self.stack[-1], len(self.nodes))
            inside = any(self.where[t] for t in ("article", "main"))
            node.marked |= tag == "header" and not inside
            self.push(node)
        else:
            if tag == "a":
                self.in_link = 1 if not top.dropped else self.in_link
            if empty or top.dropped:
                return
            node = _node(tag, attrs, top, len(self.nodes)) if attrs or tag in CONTROLS else None
            if node is not None and (node.marked or node.unseen or node.name):  # what is hidden or an advert inside a line is a block of its own
                self.flush()
                self.push(node)
                self.inline[tag].append((len(self.stack), node))
            else:
                self.inline[tag].append((len(self.stack), None))


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in page order; references are decoded, white space is one space. Their nodes tell whether
    they are in furniture or in an article.

    An element that its name alone makes furniture, a form or a header is none if most of its text is an article, and most that
    the page has in articles; what readers say never is the article."""
    read = _Page(page)
    nodes, root = read.nodes, read.root
    for node in reversed(nodes):  # parents come first
        if node.strong and not (node.marked or node.unseen or node.name):
            node.told = node.mass
        if node.parent is not None:
            up = node.parent
            up.mass, up.linked, up.prose, up.told = up.mass + node.mass, up.linked + node.linked, up.prose + node.prose, up.told + node.told
    strong, marks = root.told > 0, any(node.strong for node in nodes)
    for node in nodes:
        up = node.parent
        tells = node.told > 0 and 2 * node.told >= max(node.mass, root.told) and node.name != READERS
        whole = not marks and node.mass >= WHOLE * root.mass and node.linked < LINKED * node.mass
        own = node.name != PLAIN and not (tells or node.name == LAYOUT and whole)
        if node.marked:
            form = node.tag in ("form", "fieldset")
            own |= not (tells and (form or node.tag == "header") or form and whole and node.prose >= WHOLE * node.mass)
        node.furniture = own or node.unseen or (up is not None and up.furniture)
        node.article = (node.strong if strong else node.weak) or (up is not None and up.article)
    return read.blocks


def log_odds(found: list[Block]) -> list[float]:
    w, has_article = WEIGHTS, any(b.node.article and not b.node.furniture for b in found)
    out = []
    for b in found:
        words = b.text.count(" ") + 1
        s = w["bias"] + w["length"] * min(3.0, math.log2(1 + words) / 2) + w["links"] * b.linked / len(b.text)
        s += w["furniture"] * b.node.furniture + w["paragraph"] * b.paragraph + w["heading"] * b.heading + w["list"] * b.listed
        if b.text[-1] in ".!?…\"'»)”" and words > 3:
            s += w["stops"]
        if b.text[0] == "©" or "all rights reserved" in b.text[:200].lower():
            s += w["rights"]
        if has_article:
            s += w["article"] if b.node.article else w["outside"]
        out.append(s)
    return out


def tree_distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        else:
            return steps + 2
        steps += 1
    return steps


def minimum_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise the capacities cut; Dinic's maximum flow. Ties between labellings go to
    the smallest source side."""
    n = len(gain)
    source, sink = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0.0)
        elif g < 0:
            edge(i, sink, -g, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        ahead = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while ahead[v] < len(out[v]):
                e = out[v][ahead[v]]
                if cap[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                ahead[v] += 1
            if ahead[v] < len(out[v]):
                path.append(out[v][ahead[v]])
                v = to[path[-1]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                ahead[v] += 1
            else:
                break


def label(found: list[Block]) -> list[bool]:
    """True for the blocks that belong to the main text."""
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = b.node.parent.number if b.node.parent is not None else -1
        for j in ({i - 1} if i else set()) | ({last[parent]} if parent in last else set()):
            ties[j, i] = TIE * 0.5 ** (max(0, tree_distance(found[j].node, b.node) - 2) / 2)
        last[parent] = i
    return minimum_cut(log_odds(found), [(a, b, c) for (a, b), c in ties.items()])


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, label(found), strict=True) if keep)


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(2).to_pylist()
        for a, b in chunks(pages):
            texts = [main_text(p) for p in pages[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html; others are not read).

    Null or empty html, or a page of markup alone: empty text. Broken markup is read as far as it goes. Nulls in page_id or url
    stay; repeated rows repeat. Pages of any length are read whole. Empty table: empty result."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
