"""Main text of web pages: flat text blocks with word counts and link densities of neighbours, classified by a decision tree trained on a small labelled table.

A page is cut into blocks at block-level tags; script, style, comments and other raw elements never
give text. Of each block the tree sees its words, the share of them in links, the same of both
neighbours, whether an ancestor is marked as boilerplate (navigation, adverts, notices, forms, reader
comments and the like, by element or by whole tokens and known compounds of class, id or role; what holds the article is not
marked), with the share of the page's words outside that element, whether it lies in an article, and whether it
is a heading.

Defined cases: a null or empty page, or one without content blocks, has the empty text; broken
markup, unclosed elements and missing ends are read as far as they go; white space inside a block
is one space; repeated rows come back as often as they occur; an empty table gives no rows; other
columns are not used.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile("[<>\"']")
_LINK = re.compile(r"<a[\s>]", re.I)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Elements by what they do, and words of class, id or role that mark boilerplate or content.
RAW = frozenset("script style noscript template textarea title svg iframe object select option canvas video audio head".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav footer aside form menu button dialog fieldset header".split())
INSIDE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose ends are often left out; they don't hold others.
OPEN = frozenset("p li dd dt td th tr tbody thead tfoot".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus disclaimer footer form gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget".split()
)

#: Words that may stand beside a mark in a compound token (site-header, related-posts); others (has, with, no, overflow) make it a token of layout.
BESIDE = frozenset("area articles bar block bottom box buttons container content entry fixed global icons inner item items left link links list main module outer page panel post posts primary right row secondary section site sticky text title top unit wrap wrapper".split())
#: Marks of elements that can hold articles of their own.
APART = frozenset("comment comments disqus recommended related replies reply respond".split())

#: The labelled table: words, link density, words and link density of the block before, of the one after, marked, in an article, heading; then 1 for content. Fixed values.
LABELLED = np.array(
    [
        # menus, footers, adverts and comments, marked as such
        (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 1, 0, 0, 0), (1, 1.0, 2, 1.0, 12, 0.0, 1, 0, 0, 0), (9, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0),
        (25, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (12, 0.1, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (60, 0.0, 80, 0.0, 45, 0.0, 1, 1, 0, 0), (5, 0.0, 90, 0.0, 30, 0.0, 1, 1, 1, 0),
        (40, 0.0, 3, 0.0, 3, 0.0, 1, 1, 0, 0), (120, 0.0, 40, 0.0, 50, 0.0, 1, 0, 0, 0), (3, 0.0, 3, 0.0, 3, 0.0, 1, 0, 1, 0), (2, 0.0, 120, 0.0, 0, 0.0, 1, 1, 0, 0),
        (200, 0.0, 1, 1.0, 3, 0.0, 1, 1, 0, 0), (15, 0.5, 15, 0.5, 15, 0.5, 1, 0, 0, 0), (30, 0.0, 30, 0.0, 2, 1.0, 1, 1, 0, 0),
        # in an article, unmarked: headings, paragraphs, short lines, lists with and without links
        (10, 0.0, 9, 0.0, 120, 0.0, 0, 1, 1, 1), (1, 0.0, 1, 1.0, 2, 0.0, 0, 1, 1, 1), (120, 0.0, 10, 0.0, 80, 0.0, 0, 1, 0, 1), (2, 0.0, 2, 0.0, 4, 0.0, 0, 1, 0, 1),
        (80, 0.0, 120, 0.0, 6, 0.0, 0, 1, 0, 1), (1, 0.0, 60, 0.0, 8, 0.0, 0, 1, 0, 1), (30, 0.4, 40, 0.0, 50, 0.0, 0, 1, 0, 1), (3, 1.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1),
        (6, 0.0, 30, 0.0, 1, 1.0, 0, 1, 1, 1), (14, 0.2, 14, 0.1, 14, 0.3, 0, 1, 0, 1), (45, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
        (2, 1.0, 10, 0.0, 12, 0.0, 0, 1, 0, 1), (500, 0.0, 10, 0.0, 9, 0.0, 0, 1, 0, 1), (5, 0.0, 5, 0.0, 5, 0.0, 0, 1, 0, 1), (20, 1.0, 20, 0.0, 30, 0.0, 0, 1, 0, 1),
        (1, 1.0, 2, 0.0, 30, 0.0, 0, 1, 1, 1), (7, 1.0, 7, 1.0, 7, 1.0, 0, 1, 0, 1), (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0, 1),
        # in no article: text by its length and its links
        (80, 0.0, 10, 0.0, 90, 0.0, 0, 0, 0, 1), (35, 0.05, 80, 0.0, 40, 0.0, 0, 0, 0, 1), (22, 0.1, 60, 0.0, 3, 1.0, 0, 0, 0, 1), (60, 0.25, 30, 0.0, 50, 0.0, 0, 0, 0, 1),
        (18, 0.0, 18, 0.0, 25, 0.0, 0, 0, 0, 1), (150, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1), (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (6, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 1),
        (4, 0.0, 2, 1.0, 90, 0.0, 0, 0, 1, 1), (9, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 1), (11, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 1), (3, 0.0, 70, 0.0, 60, 0.0, 0, 0, 0, 1),
        (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (3, 0.9, 4, 1.0, 5, 0.8, 0, 0, 0, 0), (25, 0.9, 3, 1.0, 30, 0.8, 0, 0, 0, 0),
        (40, 0.7, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0, 0), (7, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 0),
        (8, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (4, 0.0, 80, 0.0, 2, 1.0, 0, 0, 0, 0), (6, 0.5, 50, 0.0, 40, 0.0, 0, 0, 0, 0), (2, 0.0, 2, 1.0, 1, 1.0, 0, 0, 1, 0),
        (3, 0.0, 5, 0.0, 2, 1.0, 0, 0, 1, 0), (10, 0.6, 10, 0.6, 10, 0.6, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 0), (12, 0.5, 70, 0.0, 1, 1.0, 0, 0, 0, 0),
        # in no article: headings of text, headings of links, and short lines before text
        (3, 0.0, 1, 1.0, 40, 0.0, 0, 0, 1, 1), (4, 0.0, 1, 1.0, 35, 0.0, 0, 0, 1, 1), (2, 0.0, 0, 0.0, 25, 0.0, 0, 0, 1, 1), (5, 0.0, 70, 0.0, 20, 0.0, 0, 0, 1, 1),
        (3, 0.0, 60, 0.0, 30, 0.0, 0, 0, 1, 1), (2, 0.0, 2, 1.0, 4, 1.0, 0, 0, 1, 0), (1, 0.0, 30, 0.0, 2, 1.0, 0, 0, 1, 0), (3, 0.0, 0, 0.0, 5, 0.9, 0, 0, 1, 0),
        (4, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0), (2, 0.0, 3, 0.0, 120, 0.0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 30, 0.0, 0, 0, 0, 0),
        (90, 0.0, 3, 0.0, 80, 0.0, 0, 0, 0, 1), (40, 0.0, 3, 0.0, 30, 0.0, 0, 0, 0, 1), (60, 0.0, 1, 1.0, 70, 0.0, 0, 0, 0, 1), (120, 0.1, 4, 0.0, 45, 0.0, 0, 0, 0, 1),
        (30, 0.0, 2, 0.0, 25, 0.0, 0, 0, 0, 1), (45, 0.2, 1, 0.0, 60, 0.1, 0, 0, 0, 1), (50, 0.0, 5, 1.0, 40, 0.0, 0, 0, 0, 1), (25, 0.0, 4, 0.0, 60, 0.0, 0, 0, 0, 1),
        (60, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 1), (35, 0.0, 30, 0.0, 3, 1.0, 0, 0, 0, 1), (80, 0.1, 60, 0.0, 1, 1.0, 0, 0, 0, 1), (28, 0.0, 1, 1.0, 4, 0.9, 0, 0, 0, 1), (50, 0.2, 70, 0.1, 6, 1.0, 0, 0, 0, 1),
        (60, 0.8, 40, 0.0, 70, 0.0, 0, 0, 0, 0), (30, 0.6, 60, 0.1, 40, 0.0, 0, 0, 0, 0), (20, 1.0, 5, 1.0, 6, 1.0, 0, 0, 0, 0), (90, 0.9, 1, 1.0, 80, 0.0, 0, 0, 0, 0), (5, 1.0, 80, 0.0, 70, 0.0, 0, 0, 0, 0),
    ]
)
#: The mark is the share of the page's words outside the marked element: blocks are as above if it is a quarter or more, and as if unmarked below a mark that holds nearly the whole page.
LABELLED = np.concatenate([LABELLED, LABELLED])
LABELLED[len(LABELLED) // 2 :, 6] = np.where(LABELLED[len(LABELLED) // 2 :, 6] == 1, 0.25, 0.15)


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.share = float(y.mean()) if len(y) else 0.0
        self.split = self._best(x, y) if depth and 0 < self.share < 1 else None
        if self.split:
            f, at = self.split
            low = x[:, f] <= at
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-9, None
        total = len(y) * y.mean() * (1 - y.mean())
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for at in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= at
                gain = total - sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if gain > best + 1e-12:
                    best, found = gain, (f, float(at))
        return found

    def __call__(self, row: tuple) -> bool:
        node = self
        while node.split:
            f, at = node.split
            node = node.low if row[f] <= at else node.high
        return node.share >= 0.5


_TREE: list[Tree] = []


def tree() -> Tree:
    if not _TREE:
        _TREE.append(Tree(LABELLED[:, :-1], LABELLED[:, -1]))
    return _TREE[0]


def _is_mark(token: str) -> bool:
    """Whether a token of class, id or role is a mark, or a known compound with one."""
    parts = [p for p in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if p]
    if len(parts) > 1 and "hidden" in parts:
        return set(parts) <= {"hidden", "visually", "is"}
    return any(p in MARKS for p in parts) and all(p in MARKS or p in BESIDE for p in parts)


def _marked(attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether attributes hide an element, mark it as boilerplate, mark it as one that can hold articles of its own, and mark the main part."""
    hidden = out = apart = main = False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name in ("class", "id", "role"):
            marks = [t.lower() for t in value.split() if _is_mark(t)]
            out = out or bool(marks) or value.lower() in ("complementary", "contentinfo")
            apart = apart or any(w in APART for t in marks for w in re.split(r"[^a-z]+", t))
            main = main or (name == "role" and value.lower() in ("main", "article"))
    return hidden, out, apart, main


class _Element:
    """An open element: closed to content for certain (hard) or by a mark (soft), the element around it, and the page's words before its start and before its end."""

    def __init__(self, name: str, attrs: str, around: _Element | None, words: int):
        hidden, marked, self.apart, main = _marked(attrs) if attrs else (False,) * 4
        self.name, self.around, self.begin, self.end = name, around, words, None
        self.inside = main or name in INSIDE
        self.hard = hidden or (name in OUTSIDE and name != "form")
        self.soft = (marked or name == "form") and name != "main"
        self.header = name == "header" or (marked and not hidden and "header" in attrs.lower())
        self.any_inside = self.inside or bool(around and around.any_inside)
        self.any_hard = self.hard or bool(around and around.any_hard)
        self.freed: str | None = None

    def free(self, name: str) -> None:
        """What holds the article is no boilerplate; what holds main is none whatever its mark."""
        x = self.around
        while x and x.freed not in (name, "main"):
            x.soft, x.freed = x.soft and x.apart and name != "main", name
            x = x.around


class _Tags:
    """The tags of a page from left to right. No part of the page is searched again for an end that is not there."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.open: set[int] = set()  # of '<' outside quotes from which no end outside quotes follows
        self.raw: set[str] = set()
        self.close = -1

    def end(self, at: int) -> int:
        """Where the tag that begins at at ends: at the first '>' outside quotes, or at the first at all if there is none outside."""
        page = self.page
        first = page.find(">", at)
        if page.find('"', at, first) < 0 and page.find("'", at, first) < 0:
            return first
        if page.find("'", at, first) < 0 and page.count('"', at, first) % 2 == 0:
            return first
        seen, i = [at], at + 1
        while (m := _STOP.search(page, i)) and m.start() not in self.open:
            c, i = m[0], m.end()
            if c == ">":
                return m.start()
            if c == "<":
                seen.append(m.start())
            else:
                i = page.find(c, i) + 1
                if not i:
                    break
        self.open.update(seen)
        return first

    def after_raw(self, name: str, at: int) -> int:
        """Where the element's end tag ends, -1 if it has none."""
        if name not in self.raw:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
            if close:
                return close.end()
            self.raw.add(name)
        return -1

    def link_closes(self, at: int) -> bool:
        """Whether an end of a link comes before the next link begins."""
        if self.close is not None and self.close < at:
            found = re.compile("</a", re.I).search(self.page, at)
            self.close = found.start() if found else None
        if self.close is None:
            return False
        return _LINK.search(self.page, at, self.close) is None


def blocks(page: str | None) -> list[tuple[str, int, int, float, bool, bool]]:
    """Text, words, linked words, mark, in an article, heading of each block that has text, in page order. The mark is 0 without one, 1 in elements that never hold content, else the share of the page's words outside the marked element.

    The work grows in proportion to the page, whatever is nested, unclosed or quoted in it. A link ends
    with the paragraph, heading or other element that it begins in; one without an end of its own, at the next block.
    """
    page = page or ""
    out: list[tuple[str, int, int, _Element | None, bool]] = []
    parts: list[str] = []
    linked = total = at = 0
    tags, end, top = _Tags(page), len(page), None
    depth, names = 0, Counter()
    heading = found = False
    link = paragraph = None  # of an open link: the paragraph and the depth it begins in, and whether it is closed later

    def flush() -> None:
        nonlocal linked, total
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            n = text.count(" ") + 1
            total += n
            out.append((text, n, min(n, linked), top, heading))
        linked = 0

    while at < end:
        start = page.find("<", at)
        if start < 0 or (start > tags.last and not page.startswith("<!--", start)):
            start = end
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if link:
                linked += len(piece.split())
        at = start
        if at == end:
            break
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            at = close + 3 if close >= 0 else end
            continue
        m = _NAME.match(page, at + 1)
        if m is None:
            if page[at + 1] in "!?":
                at = page.find(">", at) + 1
            else:
                parts.append("<")
                at += 1
            continue
        stop = tags.end(at)
        name, attrs = m[0].lower(), page[m.end() : stop]
        closing, name, at = name[0] == "/", name.lstrip("/"), stop + 1
        if name in RAW and not closing:
            if not attrs.endswith("/"):
                after = tags.after_raw(name, at)
                at = after if after >= 0 else end if name in ("script", "style", "textarea", "template") else at
            flush() if name in BLOCKS else parts.append(" ")
        elif name == "a":
            link = None if closing else (paragraph, depth, tags.link_closes(at))
        elif name in ("br", "img", "input", "wbr"):
            parts.append(" " if name != "wbr" else "")
        elif name in BLOCKS:
            flush()
            if link and not link[2]:
                link = None
            if name in OPEN or (name[0] == "h" and name[1:].isdigit()):
                if link and link[0] is not None and (not closing or link[0] == paragraph):
                    link = None  # its paragraph ends
                heading = not closing and name not in OPEN or (name in OPEN and heading and closing)
                paragraph = None if closing else (name, at)
            elif name in VOID:
                pass
            elif closing:
                if names[name]:
                    gone = None
                    while gone != name:
                        gone, top.end, top = top.name, total, top.around
                        names[gone] -= 1
                        depth -= 1
                    paragraph = None
                    link = link if link and link[1] <= depth else None
            else:
                if link and link[0] is not None and link[0][0] not in ("li", "dd", "dt", "td", "th"):
                    link = None  # a paragraph holds no blocks
                top = _Element(name, attrs, top, total)
                depth, paragraph = depth + 1, None
                names[name] += 1
                if top.inside and not (top.soft or top.any_hard) and (name == "main" or not found):
                    found = True
                    top.free(name)
    flush()
    read, known = [], {}
    for text, n, n_linked, element, is_heading in out:
        mark, header = _mark(element, total, known)
        if is_heading and element and element.any_inside and header:
            mark = 0.0  # an article's own title in its header
        read.append((text, n, n_linked, mark, bool(element and element.any_inside), is_heading))
    return read


def _mark(element: _Element | None, total: int, known: dict) -> tuple[float, bool]:
    """The greatest mark of an element and those around it, and whether only headers are marked."""
    path = []
    while element is not None and element not in known:
        path.append(element)
        element = element.around
    mark, header = known[element] if element is not None else (0.0, True)
    for x in reversed(path):
        if x.hard or x.soft:
            words = (total if x.end is None else x.end) - x.begin
            mark, header = max(mark, 1.0 if x.hard else 1 - words / total), header and x.header
        known[x] = (mark, header)
    return mark, header


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by empty lines."""
    found = blocks(page)
    density = [b[2] / b[1] for b in found]
    classify, kept = tree(), []
    for i, (text, n, _, mark, inside, heading) in enumerate(found):
        before = (found[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if classify((n, density[i], *before, *after, mark, inside, heading)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
