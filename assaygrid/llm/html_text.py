"""HTML extraction: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text at block-level tags. A block's features are its number of words
and link density, those of the blocks before and after, whether it is a heading, and the container it
stands in (none, an article, page furniture, an article's own header). The tree is grown from the
labelled table below and nothing else. Blocks that it takes for main text are joined by line ends.

A container counts as furniture by its tag or by names in its class, id or role. A name alone proves
little: a container that holds the page's only article, or its headline and most of its words, is none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.llm.tables import arrow_batches, without

NONE, ARTICLE, FURNITURE, HEADER, HIDDEN = range(5)

# Names of HTML elements by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("hr p li dd dt td th tr tbody thead tfoot option optgroup legend caption h1 h2 h3 h4 h5 h6".split()) | frozenset(["svg", "object", "canvas", "audio", "video"])
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "math", "object", "canvas"])
FURNITURE_TAGS = frozenset("nav aside footer form head button select dialog menu search audio video fieldset datalist".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of page furniture, as a whole class, id or role or as the last part of one (site-footer); of these, some as the first part too (ad-slot).
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright "
    "dialog disclaimer disqus feedback footer foot form gdpr header login masthead menu menubar modal nav navbar navigation navigations newsletter notice notices notification overlay "
    "pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe subscription tags teaser toc toolbar topbar widget widgets complementary contentinfo alert alertdialog".split()
)
FIRST_WORDS = frozenset(
    "ad ads advert advertisement breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer gdpr login masthead menu nav navbar navigation newsletter notice "
    "pagination paywall popup promo related share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser topbar".split()
)
#: First parts of names that say something about what a container holds, not what it is (has-sidebar).
ABOUT = frozenset("has with without no is not hide show".split())
#: Whole class names and ids that mark the article.
ARTICLE_NAMES = frozenset(
    "article article-body article-content article-text articlebody body-content content entry entry-content main main-content page-content post post-body post-content story story-body".split()
)

_REPLIES = re.compile(r"comment|disqus|repl(?:y|ies)|respon[ds]", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: The labelled table. words, link density, those before, those after, container, heading, page has an article; main text?
LABELLED = """
40 0.00 30 0.00 35 0.00 1 0 1 1
 1 0.00 30 0.00 25 0.00 1 0 1 1
 2 0.00  2 0.00  1 0.00 1 0 1 1
 8 0.00  6 1.00 40 0.00 1 1 1 1
 5 1.00 30 0.00 25 0.00 1 0 1 1
12 0.60 20 0.10 18 0.00 1 0 1 1
70 0.02  8 0.00  4 1.00 1 0 1 1
 3 1.00  2 1.00  2 1.00 1 0 1 1
14 0.00  0 0.00  0 0.00 1 0 1 1
 9 0.00  1 1.00 60 0.00 1 1 1 1
 6 0.00 90 0.00  7 0.00 1 0 1 1
35 1.00 40 0.00 45 0.00 1 0 1 1
 1 1.00  1 1.00  1 1.00 2 0 1 0
 9 0.00  1 1.00 11 0.00 2 0 1 0
30 0.00 40 0.00 28 0.00 2 0 1 0
60 0.05 20 0.00 30 0.00 2 0 1 0
 6 0.00 10 0.00 30 0.00 2 1 1 0
14 0.20 50 0.00  0 0.00 2 0 1 0
 8 0.00  1 1.00 12 0.00 2 0 1 0
12 0.00 70 0.00  0 0.00 2 0 1 0
 2 1.00 45 0.00  3 1.00 2 0 1 0
40 0.00 35 0.00 50 0.00 2 0 1 0
 7 0.00  5 1.00 30 0.00 3 1 1 1
 6 0.00  7 0.00 30 0.00 3 0 1 0
 4 0.50  7 0.00 30 0.00 3 0 1 0
 1 0.00  0 0.00  2 0.00 3 1 1 1
12 0.00  0 0.00  9 0.00 3 1 1 1
 3 1.00 12 0.00  5 0.00 3 1 1 1
 2 0.00 12 0.00 60 0.00 3 0 1 0
25 0.00  1 0.00  4 0.00 3 0 1 0
 9 1.00  0 0.00  2 0.00 3 0 1 0
12 0.00  3 1.00  8 0.00 0 0 1 0
40 0.00  3 1.00  8 0.00 0 0 1 0
25 0.10 12 0.00 20 0.00 0 1 1 0
 2 1.00  2 1.00  2 1.00 0 0 1 0
 8 0.00  0 0.00 30 0.00 0 0 1 0
45 0.00 38 0.00 42 0.00 0 0 0 1
60 0.05  7 0.00 55 0.02 0 0 0 1
25 0.10 40 0.00 30 0.10 0 0 0 1
18 0.00 20 0.00  4 1.00 0 0 0 1
20 0.30 22 0.00 19 0.00 0 0 0 1
 6 0.00  3 1.00 40 0.00 0 1 0 1
 4 0.00 30 0.00 35 0.00 0 1 0 1
 3 0.00 30 0.00 28 0.00 0 0 0 1
 8 0.00 45 0.00 20 0.00 0 0 0 1
40 0.00  3 0.00  2 0.00 0 0 0 1
30 0.00  2 0.00  3 0.00 0 0 0 1
55 0.00  4 1.00  5 1.00 0 0 0 1
22 0.05  0 0.00  1 1.00 0 0 0 1
35 0.00  2 1.00  0 0.00 0 0 0 1
 3 0.00  0 0.00  0 0.00 0 0 0 1
30 0.00  0 0.00  0 0.00 0 0 0 1
 8 0.00  0 0.00  0 0.00 0 0 0 1
 1 1.00  1 1.00  1 1.00 0 0 0 0
 2 1.00  0 0.00  3 1.00 0 0 0 0
 5 0.00  2 1.00  3 1.00 0 0 0 0
 4 0.00  3 1.00  2 0.50 0 1 0 0
 7 0.40  2 1.00  0 0.00 0 0 0 0
20 0.90  6 1.00 10 0.80 0 0 0 0
30 0.70 40 0.00  8 1.00 0 0 0 0
 9 0.00  6 1.00  4 1.00 0 0 0 0
 3 0.00  4 0.00  2 0.00 0 0 0 0
 6 0.00  5 0.00  0 0.00 0 0 0 0
 1 1.00  1 1.00  2 1.00 2 0 0 0
10 0.00 60 0.00  5 0.00 2 0 0 0
40 0.00 60 0.00 30 0.00 2 0 0 0
25 0.10  8 0.00 12 0.00 2 1 0 0
30 0.00 25 0.00 45 0.00 2 0 0 0
 7 0.00  0 0.00  1 1.00 2 0 0 0
"""


@dataclass
class Node:
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None
    main: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A binary tree by Gini impurity; of equally good cuts the first feature's lowest."""
    node = Node(main=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            worth = sum(2 * p.mean() * (1 - p.mean()) * len(p) for p in (y[low], y[~low]))
            if best is None or worth < best[0] - 1e-12:
                best = (worth, f, float(at), low)
    if best is None:
        return node
    _, node.feature, node.at, low = best
    node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def decide(node: Node, row: list[float]) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.at else node.high
    return node.main


@lru_cache
def tree() -> Node:
    table = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    # containers are kinds, not amounts: a column for each
    kinds = table[:, 6:7] == np.arange(4)
    return grow(np.column_stack([table[:, :6], kinds, table[:, 7:9]]), table[:, 9] > 0)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    container: int
    heading: bool


def _furniture(name: str) -> bool:
    """Whether a whole class, id or role names page furniture."""
    parts = [p.lower() for p in _PART.findall(name)]
    return name.lower() in FURNITURE_WORDS or bool(parts) and parts[0] not in ABOUT and (parts[-1] in FURNITURE_WORDS or parts[0] in FIRST_WORDS)


def _kind(tag: str, attributes: str, inside: int) -> tuple[int, bool]:
    """What a container of the tag is, inside one of a kind; and whether it claims to be the article."""
    names: list[str] = []
    role, part = "", ""
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += value.split()
            elif name == "role":
                role = value.lower()
            elif name == "itemprop":
                part = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return HIDDEN, False
    marked = any(map(_furniture, names)) or role in FURNITURE_WORDS
    claims = tag in ("article", "main") or role in ("main", "article") or part == "articlebody"
    if inside in (FURNITURE, HIDDEN) or marked and claims:
        return max(inside, FURNITURE), False
    if claims:
        return ARTICLE, True
    if tag in ("body", "html"):
        return inside, False
    if tag == "header" or role == "banner" or marked and any(_PART.findall(n)[-1:] == ["header"] for n in names):
        return (HEADER if inside in (ARTICLE, HEADER) else FURNITURE), False
    if tag in FURNITURE_TAGS or marked:
        return FURNITURE, False
    return (ARTICLE, True) if {n.lower() for n in names} & ARTICLE_NAMES else (inside, False)


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page, in its order.

    Where all articles lie in containers that look like furniture, those around the first are not; where there is no
    article, one that holds a headline and over half of the words outside of links is not; and where articles have no text but
    headings outside of such containers, the one inside an article with the most words outside of links is not, if it is not comments.
    """
    found, suspects, articles = _cut(page, frozenset())
    plain = sum(b.words - b.linked for b in found if b.container != HIDDEN)
    if articles and not any(b.container == ARTICLE and not b.heading for b in found):
        inner = {i: s["plain"] for i, s in suspects.items() if s["inner"] and s["plain"] > 0}
        if inner:
            found = _cut(page, frozenset([max(inner, key=lambda i: (inner[i], -i))]))[0]
    if not articles:
        wrong = {i for i, s in suspects.items() if s["article"]} or {i for i, s in suspects.items() if s["headline"] and 2 * s["plain"] > plain}
        if wrong:
            found = _cut(page, frozenset(wrong))[0]
    return [b for b in found if b.container != HIDDEN]


def _cut(page: str, cleared: frozenset[int]) -> tuple[list[Block], dict[int, dict], int]:
    """Blocks; by number what the outermost furniture containers hold; the number of articles outside. cleared: numbers of those that are none."""
    out: list[Block] = []
    suspects: dict[int, dict] = {}
    stack: list[tuple[str, int]] = []
    parts: list[tuple[str, bool]] = []
    kind, heading, link, at, n = NONE, False, 0, 0, len(page)
    count, articles = 0, 0
    open_: list[tuple[int, int]] = []  # depth and number of furniture containers that stand open

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
                words = text.count(" ") + 1
                out.append(Block(text, words, linked, kind, heading))
                for _, i in open_:
                    suspects[i]["plain"] += max(words - linked, 0)
            parts.clear()

    def enter(name: str, attributes: str) -> int:
        nonlocal count, articles
        inside = stack[-1][1] if stack else NONE
        count += 1
        found, claims = _kind(name, attributes, NONE if inside == FURNITURE and name in ("article", "main") else inside)
        if found == FURNITURE and count in cleared:
            found = inside
        elif claims and inside == FURNITURE:
            # an article inside furniture: the page's, if the first of them, or else a comment
            if not any(s["article"] for s in suspects.values()):
                for _, i in open_:
                    suspects[i]["article"] = True
            found = FURNITURE
        elif claims:
            articles += 1
        if found == FURNITURE:
            # furniture by its name alone, inside an article and not of comments
            inner = inside == ARTICLE and name not in FURNITURE_TAGS and not _REPLIES.search(attributes)
            suspects[count] = {"article": False, "headline": False, "plain": 0, "inner": inner}
            open_.append((len(stack), count))
        stack.append((name, found))
        return found

    def leave() -> str:
        if open_ and open_[-1][0] == len(stack) - 1:
            open_.pop()
        return stack.pop()[0]

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append((page[at:], link > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            parts.append((" ", False))
            continue
        if name in RAW and not closing:
            close() if name in BLOCKS else None
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name not in BLOCKS and name not in CONTAINERS:
            continue
        close()
        if name in HEADINGS:
            heading = not closing
            if name == "h1" and heading:
                for _, i in open_:
                    suspects[i]["headline"] = True
        elif name in ("p", "div", "section", "article"):
            heading = False
        if name == "p" or name in HEADINGS:
            if not closing and attributes and (own := _kind(name, attributes, kind)[0]) in (FURNITURE, HIDDEN) and own != kind:
                # a marked paragraph is furniture up to its end or the next block
                stack.append((name, own))
                kind = own
            elif stack and stack[-1][0] in ("p", *HEADINGS):
                leave()
                kind = stack[-1][1] if stack else NONE
            continue
        if stack and stack[-1][0] in ("p", *HEADINGS):
            leave()
            kind = stack[-1][1] if stack else NONE
        if name in CONTAINERS or name == "li":
            if closing:
                if any(t == name for t, _ in stack):
                    while leave() != name:
                        pass
                    link = 0
            elif name == "body":
                while stack and stack[-1][0] in ("head", "html"):
                    leave()
                enter(name, attributes)
            elif name != "li" and name not in VOID and not (attributes.endswith("/") and name in ("svg",)):
                enter(name, attributes)
            kind = stack[-1][1] if stack else NONE
    close()
    return out, suspects, articles


def main_text(page: str | None) -> str:
    """The main text of a page; empty if it has none."""
    found = blocks(page or "")
    has_article = float(any(b.container in (ARTICLE, HEADER) for b in found))
    shape = [(float(b.words), b.linked / b.words) for b in found]
    kept = []
    for i, b in enumerate(found):
        before = shape[i - 1] if i else (0.0, 0.0)
        after = shape[i + 1] if i + 1 < len(found) else (0.0, 0.0)
        kinds = [float(b.container == k) for k in range(4)]
        if decide(tree(), [*shape[i], *before, *after, *kinds, float(b.heading), has_article]):
            kept.append(b.text)
    return "\n".join(kept)


def extract_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with text (main text of the whole html, empty if none) and n_chars (its code points).

    Null and empty html: empty text. Repeated rows are each extracted. Columns of pages named as a result's
    are replaced (unless it is the html itself). An empty table gives an empty result.
    """
    arrow_batches(pages.sparkSession)
    base = without(pages, *({"text", "n_chars"} - {page}))
    name = "_text" if page == "text" else "text"
    schema = T.StructType([*base.schema, T.StructField(name, T.StringType()), T.StructField("n_chars", T.LongType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.schema.get_field_index(page)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, name, "n_chars"])

    out = base.mapInArrow(extracted, schema)
    return out.drop("text").withColumnRenamed("_text", "text") if page == "text" else out
