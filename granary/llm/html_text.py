"""Main text of web pages by flat text blocks and a decision tree.

A page is cut at block-level tags into a flat list of text blocks. Each block has its words, the share of them
inside links, the same of the block before and after it, whether it lies in an article or beside the page's article, and
whether it lies in an element that names itself as page furniture (``nav``, ``footer``, ``class="ad"`` and the like). A
word of furniture on a wrapper that holds the whole article (``content-sidebar-wrap``) is no such mark. A decision tree, grown
here from ``LABELLED`` (a small table of labelled blocks), tells which blocks are kept.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches

# Fixed values of HTML: elements that do not break a block of text, elements without content, and elements
# whose content is no text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object canvas audio video select option button head".split())
RAW_TEXT = set("script style textarea title iframe noscript".split())
# Elements that are page furniture by their name
FURNITURE = set("nav footer aside form menu dialog fieldset".split())
# Those of them that hold furniture whatever else they hold, and the page's head
STRONG = set("nav footer aside menu dialog header".split())
# Words of class, id and role that mark page furniture
MARKS = set(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget footer foot header masthead topbar toolbar "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search "
    "complementary contentinfo dialog pagination pager tags skip copyright".split()
)
# Words of class, id and role that mark the article itself; they win over a mark on the same element
ARTICLE = set("article main post entry story content body text page hentry articlebody maincontent".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_article", "beside_article", "furniture", "heading")
# Labelled blocks in the order of FEATURES; the last number is 1 for main text.
LABELLED = [
    # paragraphs of an article element, long, short and at its edges
    (120, 0.0, 80, 0.0, 95, 0.0, 1, 0, 0, 0, 1),
    (45, 0.02, 10, 0.0, 60, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 140, 0.0, 30, 0.0, 1, 0, 0, 0, 1),
    (2, 0.0, 9, 0.0, 12, 0.0, 1, 0, 0, 0, 1),
    (3, 1.0, 60, 0.0, 40, 0.0, 1, 0, 0, 0, 1),
    (14, 0.5, 25, 0.0, 25, 0.1, 1, 0, 0, 0, 1),
    (9, 0.0, 12, 0.0, 30, 0.0, 1, 0, 0, 1, 1),
    (6, 0.0, 0, 0.0, 1, 0.0, 1, 0, 0, 1, 1),
    (220, 0.1, 9, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (8, 0.0, 4, 1.0, 30, 0.0, 1, 0, 0, 0, 1),
    (30, 0.0, 90, 0.0, 5, 1.0, 1, 0, 0, 0, 1),
    (2, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 0, 1),
    (60, 0.0, 1, 1.0, 3, 1.0, 1, 0, 0, 0, 1),
    (25, 0.9, 40, 0.0, 6, 1.0, 1, 0, 0, 0, 1),
    (5, 0.0, 1, 1.0, 3, 0.0, 1, 0, 0, 1, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (400, 0.0, 5, 1.0, 4, 1.0, 1, 0, 0, 0, 1),
    # furniture inside an article element
    (12, 0.0, 100, 0.0, 90, 0.0, 1, 0, 1, 0, 0),
    (40, 0.0, 100, 0.0, 40, 0.0, 1, 0, 1, 0, 0),
    (5, 1.0, 80, 0.0, 3, 1.0, 1, 0, 1, 0, 0),
    (2, 0.0, 80, 0.0, 45, 0.0, 1, 0, 1, 1, 0),
    # beside an article element, with and without a mark
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 0),
    (14, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0),
    (60, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0),
    (11, 0.0, 120, 0.0, 0, 0.0, 0, 1, 1, 0, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0),
    (25, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (70, 0.1, 70, 0.0, 60, 0.0, 0, 1, 0, 0, 0),
    (4, 0.0, 0, 0.0, 12, 0.0, 0, 1, 0, 1, 0),
    # pages without an article element: density tells
    (90, 0.0, 70, 0.0, 60, 0.0, 0, 0, 0, 0, 1),
    (40, 0.05, 12, 0.0, 55, 0.0, 0, 0, 0, 0, 1),
    (20, 0.0, 60, 0.0, 45, 0.1, 0, 0, 0, 0, 1),
    (14, 0.1, 40, 0.0, 8, 0.0, 0, 0, 0, 0, 1),
    (7, 0.0, 45, 0.0, 50, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 60, 0.0, 35, 0.0, 0, 0, 0, 0, 1),
    (8, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0, 1, 1),
    (6, 0.0, 3, 0.0, 80, 0.0, 0, 0, 0, 1, 1),
    (30, 0.2, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 1),
    (11, 0.0, 11, 0.0, 11, 0.0, 0, 0, 0, 0, 1),
    (22, 0.0, 22, 0.0, 22, 0.0, 0, 0, 0, 0, 1),
    (22, 0.0, 2, 0.0, 22, 0.0, 0, 0, 0, 0, 1),
    (22, 0.0, 3, 0.0, 3, 0.0, 0, 0, 0, 0, 1),
    (35, 0.0, 35, 0.0, 20, 1.0, 0, 0, 0, 0, 1),
    (35, 0.1, 4, 1.0, 35, 0.0, 0, 0, 0, 0, 1),
    (16, 0.3, 5, 1.0, 20, 0.3, 0, 0, 0, 0, 1),
    (60, 0.3, 100, 0.2, 100, 0.2, 0, 0, 0, 0, 1),
    (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (12, 0.0, 0, 0.0, 25, 0.0, 0, 0, 0, 0, 1),
    (12, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (300, 0.0, 300, 0.0, 300, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 22, 0.0, 22, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 15, 0.0, 15, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 15, 0.0, 200, 0.0, 0, 0, 0, 1, 1),
    (2, 0.0, 2, 1.0, 22, 0.0, 0, 0, 0, 1, 1),
    (3, 0.0, 0, 0.0, 25, 0.0, 0, 0, 0, 1, 1),
    (3, 0.0, 2, 0.5, 150, 0.0, 0, 0, 0, 1, 1),
    (3, 0.0, 30, 0.0, 30, 0.0, 0, 0, 0, 1, 1),
    (4, 0.0, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 5, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (22, 0.7, 22, 0.0, 22, 0.0, 0, 0, 0, 0, 0),
    (60, 0.6, 5, 0.0, 5, 0.0, 0, 0, 0, 0, 0),
    (200, 0.7, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (3, 0.7, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 0),
    (2, 1.0, 20, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 22, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 4, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0),
    (5, 0.9, 30, 0.0, 4, 1.0, 0, 0, 0, 0, 0),
    (30, 0.8, 10, 0.9, 12, 1.0, 0, 0, 0, 0, 0),
    (15, 0.6, 3, 1.0, 8, 0.9, 0, 0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0),
    (4, 0.0, 2, 0.5, 3, 0.0, 0, 0, 0, 0, 0),
    (6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (5, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0, 1, 0),
    # marked furniture on such pages
    (50, 0.0, 60, 0.0, 40, 0.0, 0, 0, 1, 0, 0),
    (8, 0.3, 45, 0.0, 0, 0.0, 0, 0, 1, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 1, 0, 0),
    (20, 0.1, 90, 0.0, 12, 0.0, 0, 0, 1, 0, 0),
    (4, 0.0, 30, 0.0, 50, 0.0, 0, 0, 1, 1, 0),
]


def grow_tree(rows: np.ndarray, labels: np.ndarray) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, left if at most, right) or a label."""
    if len(set(labels.tolist())) == 1:
        return (int(labels[0]),)
    gini = lambda y: 1 - (y.mean() ** 2 + (1 - y.mean()) ** 2)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= cut
            cost = left.mean() * gini(labels[left]) + (~left).mean() * gini(labels[~left])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), left)
    if best is None:
        return (int(labels.mean() >= 0.5),)
    _, f, cut, left = best
    return f, cut, grow_tree(rows[left], labels[left]), grow_tree(rows[~left], labels[~left])


def train() -> tuple:
    table = np.array(LABELLED, float)
    return grow_tree(table[:, :-1], table[:, -1])


def decide(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _mark(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the article, by its name and attributes."""
    furniture, article = name in FURNITURE, name in ("article", "main")
    if attrs:
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                furniture = furniture or key == "hidden"
                continue
            found = {w.lower() for w in WORDS_OF_NAME.findall(value)}
            if found & ARTICLE and not found & MARKS:
                article = article or name in ("div", "section", "td")
            elif found & MARKS and name not in ("body", "html", "article", "main"):
                furniture = True
    return furniture, article


def _released(found: list[tuple], weak: dict[int, bool]) -> set[int]:
    """Marked elements that are wrappers of the page and no furniture.

    ``weak`` are those marked by a word or a form, and whether a main element lies inside. Such a mark tells
    nothing about what an element holds if that is all of the page's article, or where there is none, half of the
    page's words or more. A part of the page beside an article stays what its mark says.
    """
    total, out = sum(b[1] for b in found), set()
    for e, has_main in weak.items():
        articles = [e in b[4] for b in found if b[3] and not (set(b[4]) - weak.keys())]
        size = sum(b[1] for b in found if e in b[4])
        if all(articles) and (has_main or 2 * size >= total):
            out.add(e)
    return out


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in an article, furniture, heading) of each block with text, in page order."""
    found, weak = _flat(page)
    wrappers = _released(found, weak) if weak else set()
    return [(*b[:4], not wrappers.issuperset(b[4]), b[5]) for b in found]


def _flat(page: str) -> tuple[list[tuple], dict[int, bool]]:
    """Blocks as above but with the numbers of the marked elements they lie in, and the weakly marked elements."""
    out, parts, stack = [], [], []  # stack: (name, number of a marked element or 0, article)
    links, at, n = 0, 0, len(page)
    skip = heading = article = 0
    furniture: list[int] = []
    weak: dict[int, bool] = {}
    marked = 0

    def flush():
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, in_link in parts if in_link)
                out.append((text, len(text.split()), linked, article > 0, tuple(furniture), heading > 0))
            parts = []

    def close(i):
        nonlocal skip, heading, article, links
        while len(stack) > i:
            name, f, a = stack.pop()
            if f:
                furniture.pop()
            article -= a
            skip -= name in RAW
            heading -= name in HEADINGS
            links -= name == "a"

    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at and not skip:
            parts.append((page[at:start], links > 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append((" ", False))
        elif m[1]:  # an end tag
            inside = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in INLINE:
                flush()
            if inside is not None and (name not in INLINE or all(x[0] in INLINE for x in stack[inside:])):
                close(inside)
        else:
            if name not in INLINE:
                flush()
                # a new block ends open inline elements and an open paragraph
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" and name not in RAW):
                    close(len(stack) - 1)
                if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                    close(len(stack) - 1)
            if name in VOID or (m[3] or "").rstrip().endswith("/") and name not in RAW:
                continue
            if name in RAW_TEXT:  # its content is no markup
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                continue
            f, a = _mark(name, m[3] or "")
            if name == "main":
                weak.update({e: True for e in furniture if e in weak})
            f = f or name == "header" and article == 0
            if f:
                marked += 1
                furniture.append(marked)
                if name not in STRONG:
                    weak[marked] = False
            stack.append((name, f, a))
            article += a
            skip += name in RAW
            heading += name in HEADINGS
            links += name == "a"
            if name == "body":
                skip = 0
    flush()
    return out, weak


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def features(found: list[tuple]) -> list[tuple]:
    page_article = any(b[3] and not b[4] for b in found)
    none = ("", 0, 0, False, False, False)
    rows = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        density = lambda x: x[2] / x[1] if x[1] else 0.0
        rows.append((b[1], density(b), before[1], density(before), after[1], density(after), b[3], page_article and not b[3], b[4], b[5]))
    return rows


def main_text(page: str, tree: tuple) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, row in zip(found, features(found)) if decide(tree, row))


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per page: the key columns, ``text`` and ``n_chars`` (its code points).

    NULL or empty html gives an empty text. A page without a block of main text gives an empty text. Repeated
    rows give repeated results; other columns are not read. Each page is worked on alone, whole: no exchange.
    """
    picked = pages.select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), F.col(html_col).cast("string").alias("html"))
    schema = ", ".join(f"key{i} {pages.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)) + ", text string, n_chars long"

    def make():
        tree = train()

        def run(cols):
            texts = [main_text(h, tree) if h else "" for h in cols["html"].to_pylist()]
            return {**{f"key{i}": cols[f"key{i}"] for i in range(len(keys))}, "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    out = map_batches(picked, schema, make)
    return out.select(*(F.col(f"key{i}").alias(k) for i, k in enumerate(keys)), "text", "n_chars")
