"""Main text of web pages by minimum-cut labelling.

A page's markup is read into blocks: runs of text that no block-level tag
interrupts, each with the chain of elements around it. A classifier gives each
block a cost of being content and a cost of being boilerplate (log odds from
its elements, their class and id words, link density and length); these are
the capacities of its edges to the two terminals. Neighbouring blocks, and
blocks under one parent, are joined by smoothness edges that are the stronger
the closer the blocks are in the element tree. The minimum cut of this graph,
found by blocking flows, is the cheapest labelling; the blocks on the
source's side are the article.

Text that is never shown (scripts, styles, comments, head, forms) is not a
block at all. Scale: one narrow pass, a page at a time, no shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z)
    | <(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+ | =\s*(?:"[^"]*+(?:"|\Z) | '[^']*+(?:'|\Z))? | ["'])*+)(?:>|\Z)""", re.S | re.X)
_NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: Elements whose raw content isn't markup, and elements that hold nothing to read.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNREAD = RAW | frozenset("head form button select option svg template object canvas audio video map datalist dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a new paragraph doesn't stay inside of, and the list of tags that close an open <p>.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Log odds of content that an element around a block gives, and a word of its class, id or role.
BY_TAG = {"article": 2.5, "main": 2.0, "p": 0.8, "h1": 0.8, "h2": 0.4, "h3": 0.4, "blockquote": 0.4, "pre": 0.4, "figcaption": 0.2,
          "nav": -7.0, "footer": -7.0, "aside": -6.0, "header": -4.0, "menu": -6.0, "li": -0.2, "address": -1.0}
BY_WORD = {w: v for v, words in (
    (1.5, "article content post story entry main"),
    (-6.0, "ad ads adbox adslot promo banner gdpr popup modal nav menu skip pager reply replies disqus respond signup login widget search legal copyright complementary contentinfo"),
    (-3.0, "header meta tags tagcloud alert")) for w in words.split()}
#: Parts of a class, id or role word that tell as much wherever they stand in it.
BY_PART = {w: -6.0 for w in ("advert sponsor cookie consent notice navbar navigation breadcrumb sidebar aside footer masthead toolbar pagination comment discussion "
                             "related recommend newsletter subscri share sharing social disclaimer").split()}
BIAS, LINKED, PER_WORD, MOST_WORDS = 0.3, -3.0, 0.03, 40
#: Outside of everything that holds content: on a page that has an article, and on one that hasn't.
OUTSIDE, LOOSE = -4.0, -0.3
#: A header inside an article is the article's.
OWN_HEADER = 3.0
NEAR, DEEP = 0.6, 0.5


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    names: tuple[str, ...] = ()
    hidden: bool = False


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in page order, character references decoded, white space made single and trimmed."""
    root = Node("", None, 0)
    stack, out, now, at = [root], [], None, 0
    unread = links = 0

    def flush() -> None:
        nonlocal now
        if now is not None:
            now.text = _SPACE.sub(" ", unescape("".join(now.parts))).strip()
            if now.text:
                out.append(now)
            now = None

    def add(raw: str) -> None:
        nonlocal now
        if now is None:
            if not raw.strip():
                return
            holder = next(n for n in reversed(stack) if n.tag not in INLINE)
            now = Block(holder)
        now.parts.append(raw)
        if links:
            now.linked += len(raw.strip())

    def close(n: int) -> None:
        nonlocal unread, links
        while len(stack) > n:
            gone = stack.pop()
            unread -= gone.hidden
            links -= gone.tag == "a"
            if gone.tag not in INLINE:
                flush()

    while at < len(html):
        tag = _TAG.search(html, at)
        end = tag.start() if tag else len(html)
        if end > at and not unread:
            add(html[at:end])
        if tag is None:
            break
        at = tag.end()
        closing, name, attributes = tag.groups()
        if name is None:  # a comment or declaration: no part of the text, no end of a block
            continue
        name = name.lower()
        if closing:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if i and not (name in INLINE and any(n.tag not in INLINE for n in stack[i + 1:])):
                close(i)
            elif name not in INLINE:
                flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br" and now is not None:
                now.parts.append(" ")
            continue
        if name in _ENDS_P:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag not in INLINE), 0)
            if i and stack[i].tag == "p":
                close(i)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,)
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in (*same, "ul", "ol", "dl", "table", "select")), 0)
            if i and stack[i].tag in same:
                close(i)
        elif name == "body":
            close(next((i for i, n in enumerate(stack) if n.tag == "head"), len(stack)))
        if name not in INLINE:
            flush()
        if attributes.rstrip().endswith("/") and name in ("path", "use", "circle", "rect"):
            continue
        names, gone = (), name in UNREAD
        if attributes.strip():
            found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes)]
            names = tuple(w for k, v in found if k in ("class", "id", "role") for w in _WORD.findall(v.lower()))
            gone = gone or any(k == "hidden" or k == "aria-hidden" and v.lower() == "true" for k, v in found)
        stack.append(Node(name, stack[-1], len(stack), names, gone))
        unread += gone
        links += name == "a"
        if name in RAW:
            end = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            close(len(stack) - 1)
    close(1)
    flush()
    return out


@lru_cache(maxsize=10_000)
def _of_name(name: str) -> float | None:
    value = BY_WORD.get(name)
    return next((v for part, v in BY_PART.items() if part in name), None) if value is None else value


def _of_names(node: Node) -> Iterator[tuple[str, float]]:
    """What the class, id and role words of an element say. A page's or an article's own words say nothing against it."""
    for name in node.names:
        value = _of_name(name)
        if value is not None and (value > 0 or node.tag not in ("html", "body", "article", "main")):
            yield name, value


def _anchored(block: Block) -> bool:
    node = block.node
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def log_odds(block: Block, outside: float = LOOSE) -> float:
    """How much likelier content than boilerplate a block is by itself."""
    words = block.text.count(" ") + 1
    odds = BIAS + PER_WORD * min(words, MOST_WORDS) + LINKED * min(1.0, block.linked / len(block.text))
    node, seen, inside = block.node, set(), False
    while node is not None:
        if node.tag in ("article", "main") and "header" in seen:
            odds += OWN_HEADER
            seen.discard("header")
        for key, value in [(node.tag, BY_TAG.get(node.tag)), *_of_names(node)]:
            if value is not None and key not in seen:
                seen.add(key)
                odds += value
                inside = inside or value > 1
        node = node.parent
    return odds if inside else odds + outside


def _distance(a: Node, b: Node) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbouring blocks, and between each block and the one before it under the same parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            edges[i - 1, i] = NEAR / (1 + _distance(found[i - 1].node, block.node))
        parent = id(block.node.parent)
        if (j := last.get(parent)) is not None:
            edges[j, i] = edges.get((j, i), 0.0) + DEEP / (1 + _distance(found[j].node, block.node))
        last[parent] = i
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source's side of the minimum cut: the capacity from the source is max(odds, 0), that to the
    sink max(-odds, 0), an edge holds its capacity both ways. Of equal cuts, the one with the larger source side."""
    n = len(odds)
    source, sink = [max(0.0, o) for o in odds], [max(0.0, -o) for o in odds]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        room[i][j] = room[i].get(j, 0.0) + c
        room[j][i] = room[j].get(i, 0.0) + c
    tiny, near = 1e-12, [list(r) for r in room]
    while True:  # blocking flows over shortest paths, their lengths counted back from the sink
        level = {i: 0 for i in range(n) if sink[i] > tiny}
        queue = deque(level)
        while queue:
            i = queue.popleft()
            for j in near[i]:
                if j not in level and room[j][i] > tiny:
                    level[j] = level[i] + 1
                    queue.append(j)
        starts = [i for i in level if source[i] > tiny]
        if not starts:
            return [i not in level for i in range(n)]
        tried = [0] * n
        for start in starts:
            path = [start]
            while path and source[start] > tiny:
                i = path[-1]
                if sink[i] > tiny:
                    flow = min(source[start], sink[i], *(room[a][b] for a, b in zip(path, path[1:], strict=False)))
                    source[start] -= flow
                    sink[i] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        room[a][b] -= flow
                        room[b][a] += flow
                    path = [start]
                    continue
                while tried[i] < len(near[i]):
                    j = near[i][tried[i]]
                    if level.get(j, n) == level[i] - 1 and room[i][j] > tiny:
                        path.append(j)
                        break
                    tried[i] += 1
                else:
                    path.pop()
                    if path:
                        tried[path[-1]] += 1


def main_text(html: str) -> str:
    """The article of a page, its blocks joined by line feeds."""
    found = blocks(html)
    if not found:
        return ""
    outside = OUTSIDE if any(map(_anchored, found)) else LOOSE
    odds = [log_odds(b, outside) for b in found]
    return "\n".join(b.text for b, kept in zip(found, minimum_cut(odds, smoothness(found)), strict=True) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of `pages`.

    Null html counts as empty; text is empty where a page has none; null ids
    and urls stay null; repeated rows stay repeated; other columns don't
    matter. Markup that isn't closed ends with the page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return extract(read_table(spark, sf_dir, "pages"))
