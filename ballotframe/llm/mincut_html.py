"""Main text of web pages by a minimum cut over their blocks.

A page is read into blocks of text. A linear classifier gives each block a cost for being content and one for being
boilerplate; they are the capacities to the two terminals. Length, links, sentence ends, elements and telling class names are
its inputs. Neighbours in the page are joined by smoothness edges that fall with the square of their distance in the DOM, and
siblings by one more, so that a short line between paragraphs goes with them, and a long line in a menu with the menu. The
minimum cut, found by maximum flow (Dinic), labels all blocks at least total cost.

Scripts, styles, heads, forms, hidden parts and other elements that never hold an article's text give no blocks.
Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

A page is one row and is read by itself, so nothing is shuffled. Nulls: a null html is empty and gives an empty text; page_id
and url are passed on. Repeated rows each have their row; an empty table gives no rows; further columns are not read. Very long
pages are read whole. Among cuts of equal cost the one with the fewest content blocks counts.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HINTS = re.compile(r"[a-z]+")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title noframes xmp iframe".split())
SILENT = frozenset(
    "head script style title textarea noscript template iframe object svg canvas form select button option datalist audio video map noframes dialog".split()
)
BOILERPLATE = frozenset("nav header footer aside menu address".split())
ARTICLE = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
BAD_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login popup modal overlay share sharing social "
    "related recommended recommendations comment comments reply replies disqus respond pagination pager toolbar widget copyright legal disclaimer alert hidden "
    "form search skip".split()
)
GOOD_HINTS = frozenset("article content post entry story main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


@dataclass(frozen=True)
class CutParams:
    """Weights of the classifier (log odds of content) and of the smoothness edges."""

    bias: float = -0.6
    in_article: float = 2.4
    length: float = 0.8
    links: float = -3.0
    paragraph: float = 0.6
    sentence: float = 0.5
    boilerplate: float = -7.0
    adjacent: float = 0.05
    near: float = 8.0
    sibling: float = 0.5
    far: int = 12


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int = 0
    silent: bool = False
    bad: bool = False
    article: bool = False
    link: bool = False
    paragraph: bool = False


@dataclass
class Block:
    element: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def element_of(name: str, attributes: str, parent: Element) -> Element:
    e = Element(name, parent, parent.depth + 1, parent.silent or name in SILENT, parent.bad or name in BOILERPLATE, parent.article or name in ARTICLE)
    e.link = parent.link or name == "a"
    e.paragraph = name in ("p", "blockquote", "pre") or (parent.paragraph and name in INLINE)
    if attributes and name not in ("html", "body"):
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "").lower()
            if key in ("class", "id"):
                hints = set(HINTS.findall(value))
                e.bad |= bool(hints & BAD_HINTS)
                e.article |= bool(hints & GOOD_HINTS) and name in ("div", "section", "td")
            elif key == "role":
                e.bad |= value in BAD_ROLES
                e.article |= value in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                e.silent = True
    return e


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    root = Element("", None)
    stack, blocks, now = [root], [], None
    at, size = 0, len(page)

    def close(name: str, stop: frozenset[str] = frozenset()) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                del stack[k:]
                return True
            if stack[k].name in stop:
                return False
        return False

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            top = stack[-1]
            if not top.silent:
                if now is None:
                    block_element = next(e for e in reversed(stack) if e.name not in INLINE)
                    now = Block(block_element)
                    now.element.paragraph |= top.paragraph
                    blocks.append(now)
                now.pieces.append(text)
                if top.link:
                    now.linked += len(text)
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name not in INLINE:
                now = None
                close(name)
            else:
                close(name, CLOSES_P)
            continue
        if name in INLINE:
            if name == "br" and now is not None:
                now.pieces.append(" ")
            if name in VOID:
                continue
        else:
            now = None
            if name in CLOSES_P:
                close("p", CLOSES_P - {"p"})
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(name, frozenset(("ul", "ol", "dl", "table")))
            if name in VOID:
                continue
        attributes = m["attributes"] if m["name"] else m["attributes2"]
        e = element_of(name, attributes or "", stack[-1])
        if name in RAW:
            found = re.compile(f"</{name}[^>]*>?", re.IGNORECASE).search(page, at)
            at = found.end() if found else size
        elif not (attributes or "").endswith("/") or name in INLINE:
            stack.append(e)
    for b in blocks:
        b.text = " ".join(references.unescape("".join(b.pieces)).split())
    return [b for b in blocks if b.text]


def log_odds(b: Block, p: CutParams) -> float:
    n = len(b.text)
    z = p.bias + p.length * max(-1.0, min(2.0, math.log(n / 40))) + p.links * min(1.0, b.linked / n)
    z += p.in_article * b.element.article + p.paragraph * b.element.paragraph + p.sentence * (b.text[-1] in ".!?\"'…")
    return z + p.boilerplate * b.element.bad


def distance(a: Element, b: Element, most: int) -> int:
    """Steps between two elements in the tree, or ``most`` if there are more."""
    steps = 0
    while a is not b and steps < most:
        if a.depth < b.depth:
            b = b.parent
        else:
            a = a.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block], p: CutParams) -> list[tuple[int, int, float]]:
    """Edges between neighbours, by their closeness in the tree, and between siblings with others between them."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            d = distance(blocks[k - 1].element, b.element, p.far)
            out.append((k - 1, k, p.adjacent + p.near / (1 + d) ** 2))
        parent = id(b.element.parent)
        if (j := last.get(parent, k - 1)) < k - 1:
            out.append((j, k, p.sibling))
        last[parent] = k
    return out


class Flow:
    """Maximum flow by blocking flows (Dinic); nodes 0..n-1, source n, sink n + 1."""

    def __init__(self, n: int):
        self.n, self.to, self.room, self.out = n, [], [], [[] for _ in range(n + 2)]

    def add(self, a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self) -> list[int]:
        level = [-1] * (self.n + 2)
        level[self.n] = 0
        todo = deque([self.n])
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def run(self) -> list[bool]:
        """Whether each node is on the source's side of the minimum cut."""
        sink = self.n + 1
        while (level := self.levels())[sink] >= 0:
            turn = [0] * (self.n + 2)
            path: list[int] = []
            a = self.n
            while True:
                if a == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(k for k, e in enumerate(path) if self.room[e] <= 1e-12)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while turn[a] < len(self.out[a]):
                    e = self.out[a][turn[a]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                else:
                    if not path:
                        break
                    a = self.to[path.pop() ^ 1]
                    turn[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
        return [x >= 0 for x in level[: self.n]]


def soft_plus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def content_labels(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost. ``costs``: of being content and of being boilerplate."""
    flow = Flow(len(costs))
    for k, (content, boilerplate) in enumerate(costs):
        # both terminal edges carry the smaller of their capacities at once
        if boilerplate > content:
            flow.add(flow.n, k, boilerplate - content, 0.0)
        elif content > boilerplate:
            flow.add(k, flow.n + 1, content - boilerplate, 0.0)
    for a, b, weight in edges:
        flow.add(a, b, weight, weight)
    return flow.run()


def main_text(page: str, p: CutParams | None = None) -> str:
    p = p or CutParams()
    blocks = read_blocks(page)
    odds = [log_odds(b, p) for b in blocks]
    labels = content_labels([(soft_plus(-z), soft_plus(z)) for z in odds], smoothness(blocks, p))
    return " ".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extract_text(pages: DataFrame, params: CutParams | None = None) -> DataFrame:
    """(page_id, url, text) of each page."""
    p = params or CutParams()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, p) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
