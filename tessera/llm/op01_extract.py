"""Main text of web pages: flat text blocks, their neighbours' word counts and link densities, and a decision tree.

A page becomes a flat list of text blocks. Each has its word count, link density, those of
the blocks before and after it, and what encloses it: whether an element around it is named
or marked like page furniture, and whether it lies in the article. A small labelled table of such blocks, below,
trains a decision tree (Gini impurity), and the tree classifies the blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and words of class, id and role attributes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is not text of the page.
UNREAD = frozenset("script style noscript template title textarea iframe object svg math select option button canvas audio video head".split())
RAW = frozenset("script style noscript template title textarea iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
FURNITURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs tabbar toolbar topbar header masthead banner brand logo footer foot copyright colophon legal "
    "aside sidebar sidebars rail widget widgets related recommended recommendations trending popular teaser teasers cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay paywall "
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promoted outbrain taboola form search login signin signup register "
    "comment comments commentlist respond reply replies disqus discussion reactions share sharing social follow skip hidden contentinfo complementary dialog byline".split()
)
ARTICLE = frozenset("article content main post entry story articlebody maincontent".split())

#: The labelled blocks: words, link density, the same of the block before and of the block after,
#: furniture around it (0, 1), article (2: in it, 1: the page marks none, 0: outside), label.
LABELLED = np.array([
    # in the article, whatever the length
    (62, 0.00, 12, 0.00, 48, 0.00, 0, 2, 1), (48, 0.02, 62, 0.00, 1, 0.00, 0, 2, 1), (1, 0.00, 48, 0.02, 35, 0.00, 0, 2, 1), (9, 0.00, 0, 0.00, 62, 0.00, 0, 2, 1),
    (4, 1.00, 30, 0.00, 41, 0.05, 0, 2, 1), (2, 0.00, 3, 0.00, 0, 0.00, 0, 2, 1), (120, 0.10, 1, 1.00, 90, 0.00, 0, 2, 1), (17, 0.55, 22, 0.00, 6, 0.00, 0, 2, 1),
    (7, 0.00, 5, 1.00, 8, 0.00, 0, 2, 1), (33, 0.00, 2, 1.00, 3, 1.00, 0, 2, 1), (12, 0.90, 11, 0.80, 40, 0.00, 0, 2, 1), (3, 0.00, 6, 0.00, 0, 0.00, 0, 2, 1),
    (1, 0.00, 1, 0.00, 1, 0.00, 0, 2, 1), (1, 0.00, 2, 0.00, 80, 0.00, 0, 2, 1), (2, 0.00, 2, 1.00, 1, 0.00, 0, 2, 1), (1, 1.00, 1, 1.00, 2, 1.00, 0, 2, 1), (4, 0.00, 90, 0.00, 3, 0.00, 0, 2, 1), (6, 0.00, 1, 0.00, 4, 0.00, 0, 2, 1),
    (2, 1.00, 25, 0.00, 9, 0.00, 0, 2, 1), (10, 0.80, 5, 0.00, 1, 0.00, 0, 2, 1), (1, 0.00, 14, 0.00, 0, 0.00, 0, 2, 1), (5, 0.00, 0, 0.00, 0, 0.00, 0, 2, 1), (3, 0.50, 7, 0.90, 3, 0.50, 0, 2, 1), (8, 0.00, 3, 0.00, 2, 1.00, 0, 2, 1),
    (40, 0.00, 35, 0.00, 3, 1.00, 0, 2, 1), (8, 0.00, 60, 0.00, 4, 1.00, 0, 2, 1), (25, 0.20, 50, 0.00, 20, 0.80, 0, 2, 1), (2, 0.00, 30, 0.00, 6, 0.50, 0, 2, 1), (70, 0.00, 80, 0.10, 5, 0.60, 0, 2, 1), (12, 1.00, 40, 0.00, 9, 0.90, 0, 2, 1),
    (5, 0.50, 90, 0.00, 2, 0.40, 0, 2, 1), (3, 1.00, 48, 0.30, 4, 1.00, 0, 2, 1), (31, 0.00, 27, 0.00, 1, 1.00, 0, 2, 1), (55, 0.40, 21, 0.90, 7, 0.60, 0, 2, 1), (19, 0.00, 33, 0.00, 12, 0.35, 0, 2, 1), (90, 0.00, 44, 0.60, 60, 0.50, 0, 2, 1),
    # furniture, in the article or not
    (5, 1.00, 40, 0.00, 3, 1.00, 1, 2, 0), (20, 0.00, 60, 0.00, 10, 0.60, 1, 1, 0), (9, 0.00, 5, 1.00, 8, 0.70, 1, 2, 0), (33, 0.00, 70, 0.00, 4, 1.00, 1, 2, 0), (16, 0.00, 45, 0.00, 38, 0.00, 1, 1, 0), (7, 0.00, 52, 0.00, 47, 0.00, 1, 1, 0),
    (26, 0.10, 4, 0.00, 6, 0.00, 1, 2, 0), (48, 0.00, 3, 0.90, 51, 0.00, 1, 1, 0), (2, 0.00, 20, 0.00, 30, 0.00, 1, 2, 0), (12, 0.00, 9, 0.00, 7, 0.00, 1, 2, 0), (64, 0.00, 58, 0.00, 70, 0.00, 1, 2, 0), (4, 0.00, 36, 0.00, 29, 0.00, 1, 2, 0),
    (3, 1.00, 2, 1.00, 1, 1.00, 1, 0, 0), (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0), (9, 0.00, 1, 1.00, 14, 0.00, 1, 0, 0), (24, 0.00, 50, 0.00, 0, 0.00, 1, 0, 0),
    (40, 0.00, 38, 0.00, 44, 0.00, 1, 2, 0), (6, 0.30, 70, 0.00, 12, 0.00, 1, 2, 0), (85, 0.00, 60, 0.00, 20, 0.00, 1, 1, 0), (11, 0.00, 0, 0.00, 90, 0.00, 1, 1, 0),
    (2, 0.50, 64, 0.00, 3, 0.50, 1, 1, 0), (150, 0.00, 4, 0.00, 0, 0.00, 1, 0, 0), (30, 0.70, 31, 0.60, 28, 0.70, 1, 2, 0), (5, 0.00, 110, 0.00, 80, 0.00, 1, 2, 0),
    # outside of an article that the page marks
    (8, 0.00, 5, 1.00, 40, 0.00, 0, 0, 0), (36, 0.00, 4, 0.20, 9, 0.00, 0, 0, 0), (2, 1.00, 3, 1.00, 2, 1.00, 0, 0, 0), (70, 0.05, 60, 0.00, 0, 0.00, 0, 0, 0),
    (14, 0.00, 44, 0.00, 5, 0.00, 0, 0, 0), (1, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0), (22, 0.00, 30, 0.00, 28, 0.00, 0, 0, 0), (55, 0.00, 12, 0.00, 41, 0.00, 0, 0, 0), (110, 0.00, 70, 0.00, 64, 0.00, 0, 0, 0), (9, 0.00, 62, 0.00, 58, 0.00, 0, 0, 0),
    (160, 0.30, 120, 0.00, 15, 0.80, 0, 0, 0), (60, 0.10, 40, 0.00, 30, 0.60, 0, 0, 0), (25, 0.20, 10, 0.20, 4, 0.90, 0, 0, 0), (90, 0.00, 20, 0.50, 10, 1.00, 0, 0, 0), (40, 0.25, 80, 0.10, 50, 0.30, 0, 0, 0), (18, 0.40, 140, 0.30, 90, 0.20, 0, 0, 0),
    (75, 0.00, 35, 0.00, 130, 0.40, 0, 0, 0), (33, 0.55, 24, 0.00, 77, 0.00, 0, 0, 0), (120, 0.15, 8, 0.70, 45, 0.00, 0, 0, 0), (6, 0.00, 95, 0.00, 110, 0.50, 0, 0, 0), (48, 0.35, 66, 0.45, 21, 0.00, 0, 0, 0), (12, 0.10, 52, 0.00, 3, 0.70, 0, 0, 0),
    # a page that marks none: long blocks of few links, and short ones between them
    (45, 0.00, 9, 0.00, 52, 0.00, 0, 1, 1), (52, 0.08, 45, 0.00, 38, 0.00, 0, 1, 1), (18, 0.00, 40, 0.00, 6, 0.00, 0, 1, 1), (6, 0.00, 47, 0.00, 55, 0.00, 0, 1, 1),
    (2, 0.00, 50, 0.00, 33, 0.00, 0, 1, 1), (9, 0.00, 0, 0.00, 45, 0.00, 0, 1, 1), (21, 0.15, 3, 1.00, 39, 0.00, 0, 1, 1), (8, 0.00, 3, 1.00, 60, 0.00, 0, 1, 1),
    (5, 0.00, 48, 0.00, 4, 1.00, 0, 1, 1), (3, 0.00, 28, 0.00, 12, 0.00, 0, 1, 1), (30, 0.00, 2, 0.50, 0, 0.00, 0, 1, 1), (60, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1), (2, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1),
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 1, 0), (2, 1.00, 0, 0.00, 2, 1.00, 0, 1, 0), (6, 0.80, 5, 0.90, 45, 0.00, 0, 1, 0), (25, 0.75, 20, 0.80, 30, 0.70, 0, 1, 0),
    (4, 0.00, 3, 1.00, 2, 1.00, 0, 1, 0), (7, 0.60, 41, 0.00, 5, 0.80, 0, 1, 0), (1, 0.00, 2, 0.00, 1, 0.00, 0, 1, 0),
    (12, 0.60, 36, 0.00, 0, 0.00, 0, 1, 0), (5, 0.00, 4, 1.00, 0, 0.00, 0, 1, 0),
    # the same, where the neighbours decide
    (14, 0.00, 2, 1.00, 3, 1.00, 0, 1, 0), (14, 0.00, 42, 0.00, 36, 0.00, 0, 1, 1), (14, 0.30, 3, 0.90, 4, 1.00, 0, 1, 0), (14, 0.30, 44, 0.00, 37, 0.05, 0, 1, 1),
    (22, 0.45, 6, 0.90, 8, 0.90, 0, 1, 0), (22, 0.45, 31, 0.00, 29, 0.00, 0, 1, 1), (30, 0.50, 22, 0.80, 19, 0.80, 0, 1, 0), (30, 0.50, 36, 0.00, 42, 0.00, 0, 1, 1),
    (11, 0.00, 4, 0.90, 5, 0.90, 0, 1, 0), (11, 0.00, 4, 0.90, 33, 0.00, 0, 1, 1), (3, 0.00, 3, 1.00, 36, 0.00, 0, 1, 1), (6, 0.00, 3, 1.00, 2, 1.00, 0, 1, 0),
    (27, 0.00, 29, 0.00, 0, 0.00, 0, 1, 1), (26, 0.00, 2, 0.00, 1, 1.00, 0, 1, 1), (29, 0.00, 1, 1.00, 5, 0.80, 0, 1, 1), (60, 0.00, 55, 0.00, 1, 1.00, 0, 1, 1), (35, 0.00, 8, 0.00, 2, 1.00, 0, 1, 1), (24, 0.00, 38, 0.00, 3, 0.90, 0, 1, 1),
    (31, 0.10, 45, 0.00, 0, 0.00, 0, 1, 1), (80, 0.00, 1, 1.00, 3, 1.00, 0, 1, 1), (20, 0.00, 25, 0.00, 0, 0.00, 0, 1, 1), (45, 0.00, 2, 1.00, 2, 1.00, 0, 1, 1),
    (17, 0.00, 2, 1.00, 41, 0.00, 0, 1, 1), (17, 0.00, 45, 0.00, 3, 1.00, 0, 1, 1), (10, 0.35, 46, 0.00, 31, 0.00, 0, 1, 1), (10, 0.35, 5, 0.80, 6, 0.70, 0, 1, 0),
], float)


@dataclass
class Tree:
    """A node: a class, or a feature, a threshold and the nodes for values below and above it."""

    label: int
    feature: int = -1
    at: float = 0.0
    below: Tree | None = None
    above: Tree | None = None

    def of(self, x: tuple) -> int:
        node = self
        while node.feature >= 0:
            node = node.below if x[node.feature] <= node.at else node.above
        return node.label


def grown(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Splits by the largest fall of Gini impurity until the leaves are pure; ties go to the earlier feature and the smaller threshold."""
    node = Tree(int(2 * y.sum() > len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = 1e-12
    whole = len(y) * _gini(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            gain = whole - low.sum() * _gini(y[low]) - (~low).sum() * _gini(y[~low])
            if gain > best + 1e-12:
                best, node.feature, node.at = gain, f, float(at)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.at
        node.below, node.above = grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1)
    return node


def _gini(y: np.ndarray) -> float:
    p = y.mean()
    return 2 * p * (1 - p)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    furniture: bool = False
    article: int = 0  # the number of the article element around it; 0: none
    marked: bool = False  # an element around it is named like an article's
    text: str = ""
    words: int = 0
    density: float = 0.0


_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*))", re.S)
_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_MARKS = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\s(hidden)(?=[\s/>=]|$)""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
# Words of a name after which it says what the element is laid out with, and last words that name a state, not a kind.
MODIFIERS = frozenset("has have having with without no non not is are if for".split())
STATES = frozenset("open opened closed enabled disabled allowed".split())
#: Elements that may stand in a head; any other one ends it.
IN_HEAD = frozenset("title meta link base style script noscript template".split())


def _kinds(value: str) -> set[str]:
    """The words by which the names of a class, id or role attribute say what the element is (``post has-comments``: post)."""
    found = set()
    for name in value.split():
        own = [x.lower() for x in _WORDS.findall(name)]
        if len(own) > 1 and own[-1] in STATES:
            continue
        for word in own:
            if word in MODIFIERS:
                break
            found.add(word)
    return found


def _cues(attributes: str) -> tuple[bool, bool]:
    """(marked as furniture, marked as the article)."""
    furniture = article = False
    for m in _MARKS.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if m[5] or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            furniture = True
        elif name in ("class", "id", "role"):
            found = _kinds(value)
            furniture |= not found.isdisjoint(FURNITURE)
            article |= not found.isdisjoint(ARTICLE)
    return furniture, article


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in its order, those without text left out."""
    found: list[Block] = []
    block, at, links, articles = Block(), 0, 0, 0
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # element, furniture, article, marked; as they hold inside
    unread = 0

    def cut(i: int) -> None:
        """Ends the open elements from the i-th on."""
        nonlocal unread
        unread -= sum(x[0] in UNREAD for x in stack[i:])
        del stack[i:]

    def text(raw: str) -> None:
        if unread and stack[-1][0] == "head" and raw.strip():  # text ends a head
            cut(len(stack) - 1)
        if raw and not unread:
            plain = html.unescape(raw)
            block.parts.append(plain)
            if links:
                block.links.append(plain)

    def broken() -> None:
        nonlocal block
        if block.parts:
            _, block.furniture, block.article, block.marked = stack[-1]
            found.append(block)
            block = Block()

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        end = _END.match(page, at)
        close = end.end() if end else page.find(">", at) + 1 or len(page)
        attributes, at = page[at:close], close
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in INLINE:
                pass
            else:
                broken()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        cut(i)
                        break
            continue
        if name == "br":
            text(" ")
        elif name == "a":
            links += 1
        elif name in INLINE:
            pass
        else:
            broken()
            if stack[-1][0] == "head" and name not in IN_HEAD:
                cut(len(stack) - 1)
            links = 0 if name in ("p", "div", "li", "td") else links
            if name in VOID or attributes.rstrip(">").endswith("/") and name not in RAW and name not in ("p", "div", "article"):
                continue
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = stop.start() if stop else len(page)
                if stop:
                    at = page.find(">", at) + 1 or len(page)
                continue
            if name == "p" or name == "li":  # closed by the next of their kind
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        cut(i)
                    elif stack[i][0] in UNREAD or stack[i][0] in ("ul", "ol", "div", "article", "section", "td", "blockquote", "nav", "aside", "footer", "header", "main", "form"):
                        break
            _, furniture, article, marked = stack[-1]
            cue, named = _cues(attributes) if name not in ("html", "body", "main") else (False, False)
            if name == "article" and not cue:
                furniture = furniture and article > 0
                if not article:
                    articles += 1
                    article = articles
            heading = name == "header" and article > 0 and not cue  # an article's own header has its title
            furniture = furniture or cue or name in FURNITURE_TAGS and not heading
            unread += name in UNREAD
            stack.append((name, furniture, article, marked or named and not furniture or name == "main"))
    broken()
    kept = []
    for b in found:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            b.words = len(b.text.split())
            b.density = min(1.0, len("".join(b.links).split()) / b.words) if b.links else 0.0
            kept.append(b)
    return kept


def main_text(page: str, tree: Tree) -> tuple[str, list[tuple[str, bool]]]:
    """The main text, and all blocks with their class."""
    found = blocks(page)
    size: dict[int, int] = {}
    for b in found:
        if b.article and not b.furniture:
            size[b.article] = size.get(b.article, 0) + b.words
    main = {a for a, n in size.items() if n >= 0.3 * max(size.values())}
    marks = not main and any(b.marked and not b.furniture for b in found)
    shape = [(b.words, b.density) for b in found]
    shape = [(0, 0.0), *shape, (0, 0.0)]
    out = []
    for i, b in enumerate(found):
        place = (2 if b.article in main else 0) if main else (2 if b.marked else 0) if marks else 1
        out.append((b.text, bool(tree.of((*shape[i + 1], *shape[i], *shape[i + 2], int(b.furniture), place)))))
    return " ".join(t for t, keep in out if keep), out


def extracted(pages: DataFrame, labelled: np.ndarray = LABELLED) -> DataFrame:
    """``pages`` (html, ...) with text, n_chars and n_blocks for each row; the other columns but html are kept.

    text is the main text: white space within a block is one space, blocks are joined by one space. n_chars are its
    code points, n_blocks the text blocks of the whole page. A null, empty or textless page has the empty text. A page of any
    length is read whole, in one pass.
    Columns named like the results are replaced. Repeated rows come back each.
    """
    tree = grown(labelled[:, :-1], labelled[:, -1])
    pages = pages.drop("text", "n_chars", "n_blocks").withColumn("html", F.col("html").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n = [], []
            for page in b.column("html").to_pylist():
                text, all_blocks = main_text(page or "", tree)
                out.append(text.encode("utf-8", "replace").decode())
                n.append(len(all_blocks))
            names = [x for x in b.schema.names if x != "html"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(n, pa.int64())], names=[*names, "text", "n_chars", "n_blocks"])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html"]
    return pages.mapInArrow(run, ", ".join([*shape, "text string", "n_chars long", "n_blocks long"]))
