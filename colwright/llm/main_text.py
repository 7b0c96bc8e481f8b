"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. A block has its number of words, its link density, both of its two neighbours,
and two marks of place: inside an element that is page furniture by tag, role or name, and inside the article, if the page
has one with words that are not furniture. A class name or id counts as a whole. It marks what it holds whatever its length,
unless its element encloses the page's article or all of the page's text; names of mere boxes (``BOX_NAMES``) mark nothing either
where they hold most of the words. A decision tree, grown at start-up from the labelled table below, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colwright.llm.common import slices

# Element names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template svg iframe textarea title xmp canvas audio video".split())
FURNITURE_TAGS = frozenset("nav aside footer form head menu dialog button select option fieldset legend label".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion related replies reply share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
#: Parts of names that say where or what kind of box, not what it holds.
PLACE_NAMES = frozenset(
    "area bar body bottom box button buttons col column container content footer global header inner item items left link links "
    "list main outer page post posts primary right row secondary section site slot text thread top unit wrap wrapper".split()
)
#: Names of boxes that say nothing of what they hold.
BOX_NAMES = frozenset("modal toolbar widget widgets".split())
ARTICLE_TAGS = frozenset("article main".split())
_CLOSES_SAME = frozenset("li dt dd option tr td th".split())

#: Labelled blocks: words, link density, words and link density before, the same after, furniture (0.5 by name only), article (1 inside, -1
#: outside of one that the page has, 0 on pages without), main text. Fixed values, made by hand.
LABELLED = (
    (220, 0.0, 180, 0.0, 200, 0.0, 0.5, 0, 0), (260, 0.05, 150, 0.0, 90, 0.0, 0.5, -1, 0), (240, 0.0, 90, 0.0, 150, 0.0, 0.5, 1, 0),
    (40, 0.0, 12, 0.0, 60, 0.1, 0.5, 0, 0), (120, 0.05, 80, 0.0, 5, 0.0, 0.5, 1, 0), (9, 0.0, 0, 0.0, 30, 0.0, 0.5, -1, 0),
    (120, 0.05, 80, 0.0, 5, 0.0, 0.5, -1, 0), (150, 0.0, 60, 0.0, 90, 0.0, 0.5, -1, 0),
    (10, 0.0, 150, 0.0, 20, 0.0, 0, -1, 0), (25, 0.1, 120, 0.0, 6, 0.0, 0, -1, 0), (130, 0.0, 6, 0.0, 140, 0.0, 0, -1, 1), (180, 0.0, 0, 0.0, 160, 0.0, 0, -1, 1),
    (9, 0.0, 4, 0.0, 3, 1.0, 0.5, 1, 0), (30, 0.0, 40, 0.0, 4, 1.0, 0.5, 0, 0), (60, 0.1, 90, 0.0, 2, 1.0, 0.5, 1, 0), (20, 0.0, 6, 0.0, 30, 0.0, 0.5, 1, 0),
    (14, 0.0, 60, 0.0, 5, 1.0, 0.5, 0, 0), (50, 0.0, 20, 0.0, 20, 0.0, 0.5, 0, 0), (8, 0.0, 90, 0.0, 70, 0.0, 0.5, 0, 0), (25, 0.2, 5, 1.0, 8, 0.0, 0.5, 1, 0),
    (300, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 0), (210, 0.1, 230, 0.0, 10, 0.0, 0.5, -1, 0), (400, 0.0, 0, 0.0, 0, 0.0, 1, -1, 0), (260, 0.05, 230, 0.0, 150, 0.0, 1, 1, 0),
    (220, 0.0, 180, 0.0, 200, 0.0, 1, 0, 0), (240, 0.0, 150, 0.0, 20, 0.0, 1, 1, 0),
    (300, 0.0, 90, 0.0, 60, 0.0, 1, 0, 0), (250, 0.05, 150, 0.0, 90, 0.0, 1, -1, 0), (6, 0.0, 40, 0.0, 60, 0.0, 0.5, 1, 0),
    (6, 1.0, 0, 0.0, 4, 1.0, 1, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 1, -1, 0), (9, 0.0, 0, 0.0, 30, 0.0, 1, -1, 0),
    (40, 0.0, 12, 0.0, 60, 0.1, 1, 0, 0), (120, 0.05, 80, 0.0, 5, 0.0, 1, 1, 0), (1, 0.0, 40, 0.0, 40, 0.0, 1, 1, 0),
    (14, 0.0, 200, 0.0, 0, 0.0, 1, -1, 0), (25, 0.3, 4, 1.0, 4, 1.0, 1, 0, 0), (2, 0.0, 1, 0.0, 90, 0.0, 1, 0, 0),
    (8, 0.0, 9, 0.0, 50, 0.0, 0, 1, 1), (1, 0.0, 50, 0.0, 70, 0.0, 0, 1, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (60, 0.0, 8, 0.0, 55, 0.02, 0, 1, 1), (150, 0.1, 20, 0.0, 30, 0.0, 0, 1, 1), (35, 0.3, 80, 0.0, 90, 0.0, 0, 1, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1), (12, 0.4, 40, 0.0, 60, 0.0, 0, 1, 1), (5, 0.0, 3, 1.0, 60, 0.0, 0, 1, 1),
    (4, 0.0, 45, 0.0, 4, 0.0, 0, 1, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (7, 0.0, 7, 1.0, 7, 1.0, 0, 1, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 1, 1), (7, 1.0, 90, 0.0, 6, 1.0, 0, 1, 1), (5, 0.95, 5, 1.0, 0, 0.0, 0, 1, 1), (8, 1.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (5, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0),
    (60, 0.0, 60, 0.0, 4, 0.0, 0, 0, 1), (60, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1), (70, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1), (90, 0.1, 4, 0.0, 3, 0.0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (4, 0.0, 0, 0.0, 3, 1.0, 0, 1, 1), (3, 0.0, 2, 0.0, 60, 0.0, 0, 1, 1), (5, 0.0, 60, 0.0, 0, 0.0, 0, 1, 1), (4, 0.0, 3, 1.0, 2, 1.0, 0, 1, 1), (5, 0.0, 2, 0.0, 4, 0.0, 0, 1, 1), (3, 0.0, 0, 0.0, 9, 0.0, 0, 1, 1),
    (160, 0.0, 140, 0.0, 0, 0.0, 0, -1, 1), (150, 0.0, 150, 0.0, 8, 0.0, 0, -1, 1), (30, 0.0, 0, 0.0, 150, 0.0, 0, -1, 0), (12, 0.0, 0, 0.0, 200, 0.0, 0, -1, 0),
    (60, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1), (30, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1), (60, 0.0, 0, 0.0, 2, 1.0, 0, 0, 1), (30, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1), (100, 0.1, 60, 0.0, 2, 0.0, 0, 0, 1),
    (25, 0.0, 4, 0.0, 5, 0.0, 0, 0, 1), (40, 0.3, 4, 0.5, 6, 0.5, 0, 0, 1), (150, 0.2, 5, 1.0, 4, 1.0, 0, 0, 1), (35, 0.1, 0, 0.0, 30, 0.0, 0, 0, 1), (24, 0.0, 24, 0.0, 24, 0.0, 0, 0, 1),
    (30, 0.0, 5, 1.0, 60, 0.0, 0, -1, 0), (4, 0.0, 0, 0.0, 8, 0.0, 0, -1, 0), (80, 0.1, 3, 0.0, 3, 0.0, 0, -1, 0),
    (11, 1.0, 20, 0.0, 2, 1.0, 0, -1, 0), (2, 0.5, 2, 0.5, 2, 0.5, 0, -1, 0), (200, 0.0, 100, 0.0, 90, 0.0, 0, -1, 1),
    (150, 0.05, 120, 0.0, 80, 0.1, 0, -1, 1), (100, 0.0, 90, 0.0, 110, 0.0, 0, -1, 1), (120, 0.9, 90, 0.0, 20, 1.0, 0, -1, 0),
    (6, 0.0, 60, 0.0, 1, 0.0, 0, 1, 1), (2, 0.0, 1, 0.0, 15, 0.1, 0, 1, 1), (15, 0.1, 2, 0.0, 9, 0.0, 0, 1, 1), (40, 0.0, 15, 0.1, 8, 0.0, 0, 1, 1),
    (8, 0.0, 20, 0.0, 12, 0.0, 0, -1, 0), (20, 0.0, 60, 0.0, 60, 0.0, 0, -1, 0), (12, 0.0, 40, 0.0, 9, 0.0, 0, -1, 0), (3, 0.0, 50, 0.0, 2, 0.0, 0, -1, 0),
    (45, 0.0, 30, 0.0, 50, 0.0, 0, 0, 1), (25, 0.05, 40, 0.0, 3, 0.0, 0, 0, 1), (90, 0.2, 10, 0.0, 70, 0.1, 0, 0, 1),
    (18, 0.0, 60, 0.0, 75, 0.0, 0, 0, 1), (6, 0.0, 60, 0.0, 55, 0.0, 0, 0, 1), (7, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1),
    (3, 0.0, 40, 0.0, 45, 0.0, 0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (16, 0.1, 2, 0.0, 50, 0.0, 0, 0, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0), (8, 0.9, 40, 0.0, 5, 1.0, 0, 0, 0), (40, 0.8, 3, 1.0, 20, 0.9, 0, 0, 0),
    (2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0), (6, 0.6, 2, 0.5, 60, 0.0, 0, 0, 0), (12, 0.7, 12, 0.7, 12, 0.7, 0, 0, 0),
)


@dataclass(frozen=True)
class Tree:
    """A node asks whether a feature is at most a bound; leaves hold the class."""

    feature: int = -1
    bound: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    label: bool = False

    def classify(self, rows: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(rows), self.label)
        low = rows[:, self.feature] <= self.bound
        out = np.empty(len(rows), bool)
        out[low] = self.low.classify(rows[low])
        out[~low] = self.high.classify(rows[~low])
        return out


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Tree:
    """Split where the Gini impurity falls most (the first feature and the least bound of equals), until classes are pure."""
    if depth == 0 or labels.all() or not labels.any():
        return Tree(label=bool(labels.mean() >= 0.5)) if len(labels) else Tree()
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= bound
            a, b = labels[low], labels[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(bound), low)
    if best is None:
        return Tree(label=bool(labels.mean() >= 0.5))
    _, f, bound, low = best
    return Tree(f, bound, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def default_tree() -> Tree:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1] > 0)


_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    pieces: list[str]
    linked: list[str]
    furniture: bool
    article: int
    name: int = -1
    named: bool = False

    def words(self) -> list[str]:
        return "".join(self.pieces).split()


class _Open:
    """Open elements, with the places of each kind of them, so that none is searched for from element to element."""

    def __init__(self):
        #: tag, furniture up to here, number of the article up to here (-1 outside), number of the innermost name up to here (-1 without)
        self.elements: list[tuple[str, bool, int, int]] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> tuple[str, bool, int, int]:
        return self.elements[-1] if self.elements else ("", False, -1, -1)

    def push(self, *element) -> None:
        self.places.setdefault(element[0], []).append(len(self.elements))
        self.elements.append(element)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close(self, tag: str) -> None:
        """End the innermost element of this kind and all that it holds; nothing where none is open."""
        at = self.last(tag)
        while at >= 0 and len(self.elements) > at:
            self.places[self.elements.pop()[0]].pop()


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return True
    if found.get("role", "").lower() in FURNITURE_ROLES:
        return True
    return False


def _furniture_by_name(tag: str, attributes: str, in_article: bool) -> str:
    """Whether a class name or the id names furniture: in all of its parts, but for those of ``PLACE_NAMES`` and numbers.

    ``box`` if it names no more than a box, else ``furniture``, or nothing.
    """
    if not attributes.strip() or tag in ("html", "body", "main"):
        return ""
    kind = ""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = {p.lower() for p in _NAME_PART.findall(name) if not p.isdigit()}
        if (parts & FURNITURE_NAMES or ("header" in parts and not in_article)) and parts <= FURNITURE_NAMES | PLACE_NAMES:
            if not parts <= BOX_NAMES | PLACE_NAMES or "header" in parts:
                return "furniture"
            kind = "box"
    return kind


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. Elements that hold no reading text, comments and markup are left out."""
    out: list[Block] = []
    opened = _Open()
    names: list[tuple[int, str]] = []  # of each element that is furniture by name, the one around it and its kind
    articles: list[int] = []  # of each article the innermost name around it
    current = Block([], [], False, -1)
    at, n = 0, len(page)

    def end_block() -> None:
        nonlocal current
        if current.pieces:
            out.append(current)
        _, furniture, article, name = opened.top()
        current = Block([], [], furniture, article, name)

    def text(piece: str) -> None:
        piece = html.unescape(piece)
        current.pieces.append(piece)
        if opened.last("a") >= 0:
            current.linked.append(piece)

    while at < n:
        less = page.find("<", at)
        if less < 0:
            text(page[at:])
            break
        if less > at:
            text(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), less):
            end = page.find(">", less)
            at = n if end < 0 else end + 1
            continue
        tag_match = _TAG.match(page, less) or _LOOSE_TAG.match(page, less)
        if tag_match is None:
            if less == n - 1 or page.startswith("</", less):  # cut off, or an end tag without a name
                end = page.find(">", less)
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = less + 1
            continue
        at = tag_match.end()
        closing, tag, attributes = tag_match[1], tag_match[2].lower(), tag_match[3]
        if closing:
            opened.close(tag)
            if tag in BLOCK_TAGS:
                end_block()
            continue
        if tag in SKIPPED_TAGS:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
                stop = -1 if end is None else page.find(">", end.end())
                at = n if stop < 0 else stop + 1
            continue
        if tag in BLOCK_TAGS and tag != "br":
            opened.close("p")
        if tag in _CLOSES_SAME and opened.last(tag) > max(opened.last(t) for t in ("ul", "ol", "table", "dl", "select")):
            opened.close(tag)
        if tag == "a":
            opened.close("a")
        _, furniture, article, name = opened.top()
        if tag not in VOID_TAGS and not attributes.endswith("/"):
            furniture = furniture or _is_furniture(tag, attributes, article >= 0)
            kind = _furniture_by_name(tag, attributes, article >= 0)
            if kind:
                names.append((name, kind))
                name = len(names) - 1
            if tag in ARTICLE_TAGS:
                # by name furniture itself, it is a teaser or a comment
                articles.append(-2 if furniture or kind else name)
                article = len(articles) - 1
            opened.push(tag, furniture, article, name)
        if tag in BLOCK_TAGS or opened.top()[1::2] != (current.furniture, current.name):
            end_block()
    end_block()
    _mark_names(out, names, articles)
    return out


def _mark_names(blocks: list[Block], names: list[tuple[int, str]], articles: list[int]) -> None:
    """Mark the blocks in elements that are furniture by name.

    A name is passed over if its element holds all words of the page, or encloses the article of the page: that with the most
    words, where no article stands outside of all names. A mere box is also passed over if it holds over half of the words.
    """
    held, of_article, total = [0] * len(names), [0] * len(articles), 0
    for b in blocks:
        words = 0 if b.furniture else len(b.words())
        total += words
        if b.name >= 0:
            held[b.name] += words
        if b.article >= 0:
            of_article[b.article] += words
    for k in range(len(names) - 1, -1, -1):  # an element comes after the one around it
        if names[k][0] >= 0:
            held[names[k][0]] += held[k]
    free = [n == total or (kind == "box" and 2 * n > total) for n, (_, kind) in zip(held, names, strict=True)]
    told = [(words, -i) for i, words in enumerate(of_article) if words and articles[i] >= -1]
    if told and not any(articles[-i] == -1 for _, i in told):
        around = articles[-max(told)[1]]
        while around >= 0:
            free[around] = True
            around = names[around][0]
    marked: list[bool] = []
    for k, (around, _) in enumerate(names):
        marked.append(not free[k] or (around >= 0 and marked[around]))
    for b in blocks:
        b.named = b.name >= 0 and marked[b.name]


def block_table(blocks: list[Block]) -> tuple[np.ndarray, list[str]]:
    """Features of the blocks with words, and their texts."""
    rows, texts = [], []
    has_article = any(b.article >= 0 and not b.furniture and not b.named and b.words() for b in blocks)
    for b in blocks:
        words = b.words()
        if words:
            linked = sum(len(x.split()) for x in b.linked)
            rows.append((len(words), min(1.0, linked / len(words)), 1 if b.furniture else 0.5 if b.named else 0, 1 if b.article >= 0 else -has_article))
            texts.append(" ".join(words))
    own = np.array(rows, float).reshape(-1, 4)
    edge = np.zeros((1, 2))
    before, after = np.vstack((edge, own[:-1, :2])), np.vstack((own[1:, :2], edge))
    return np.hstack((own[:, :2], before[: len(own)], after[: len(own)], own[:, 2:])), texts


def main_text(page: str | None, tree: Tree) -> str:
    rows, texts = block_table(blocks_of(page or ""))
    if not texts:
        return ""
    return " ".join(t for t, keep in zip(texts, tree.classify(rows), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` columns, ``text`` and ``n_chars`` (code points) of every row; NULL and empty pages have an empty text.

    Pages of any length are read whole, cut-off pages up to their end. Repeated rows are handled one by one.
    """
    tree = default_tree()
    slim = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "text", "n_chars"])

    types = ", ".join(f"c{i} {slim.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    out = slim.mapInArrow(run, f"{types + ', ' if types else ''}text string, n_chars bigint")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "text", "n_chars")
