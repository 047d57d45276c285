"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is cut into blocks at block-level tags. A block has its word count and link density and those of the blocks
before and after it; whether it is a heading; whether the innermost part that tells by its tag or class says article or
surroundings (menu, advert, comments and so on); whether it comes after a heading of comments or reads like a notice. A
CART tree, fitted to the labelled pages of ``html_labels``, tells article blocks; no mark decides by itself. A part that is
called surroundings by a weak name, but holds most of the page's words, counts as unmarked.
White space inside a block becomes one space; blocks are joined in page order by one line break.

The parser takes time in proportion to the page. As in browsers, a tag, comment, script or title that never ends swallows the
rest of the page; other parts end with the element around them, and what is open at the end is closed there.

Edge cases: null or empty html gives an empty text; stray closing tags are skipped; repeated rows are treated alike; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table
from .html_labels import PAGES

# fixed values of HTML
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, and no text of the page.
RAW_TAGS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template textarea title iframe xmp".split()}

#: What an element says about its text: nothing, article, surroundings, or surroundings whatever is inside.
PLAIN, MAIN, SIDE, FAR_SIDE = range(4)
MAIN_TAGS = set("article main".split())
SIDE_TAGS = set("header form label fieldset select button option optgroup svg menu dialog".split())
FAR_SIDE_TAGS = set("nav footer aside".split())
MAIN_NAMES = set("article post content entry story main body text".split())
SIDE_NAMES = set("header masthead banner promo promoted teaser notice alert popup modal overlay signup login share sharing social related recommended widget toolbar pagination pager legal disclaimer skip search form side".split())
FAR_SIDE_NAMES = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer copyright comment comments commentlist respond disqus replies cookie cookies consent gdpr newsletter subscribe".split())
NO_NAMES = set("no not has with without is".split())

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
BLANK, NAME, EQUALS, VALUE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]+"))
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
COMMENTS = re.compile(r"(?:\d+\s+)?(?:comments?|repl(?:y|ies)|responses?|leave a (?:reply|comment)|reader comments)(?:\s*\(\d+\))?:?$", re.I)
NOTICE = re.compile(r"\u00a9|\(c\) \d|copyright|all rights reserved|cookies?\b|\bsign up\b|\bsubscribe\b|\blog in\b", re.I)


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    mark: int
    heading: bool


def mark_of(tag: str, names: list[str]) -> int:
    """What a tag and its class, id and role say."""
    if tag in ("html", "body"):
        return PLAIN
    parts = [PART.findall(x) for value in names for x in value.lower().split()]
    told = {p for own in parts if not own or own[0] not in NO_NAMES for p in own}
    if tag in FAR_SIDE_TAGS or told & FAR_SIDE_NAMES:
        return FAR_SIDE
    if tag in MAIN_TAGS or told & MAIN_NAMES:
        return MAIN
    return SIDE if tag in SIDE_TAGS or told & SIDE_NAMES else PLAIN


def tag_end(page: str, at: int) -> tuple[int, list[str], bool]:
    """From behind a tag's name: where the tag ends (-1: never), its class, id and role, and whether it closes itself."""
    names: list[str] = []
    while True:
        begin, at = at, BLANK.match(page, at).end()
        if at >= len(page):
            return -1, names, False
        if page[at] == ">":
            return at + 1, names, at > begin and page[at - 1] == "/"
        m = NAME.match(page, at)
        name, at = m[0].lower(), m.end()
        m = EQUALS.match(page, at)
        if not m:
            continue
        at = m.end()
        if page[at : at + 1] in ("'", '"'):
            end = page.find(page[at], at + 1)
            if end < 0:
                return -1, names, False
            value, at = page[at + 1 : end], end + 1
        else:
            m = VALUE.match(page, at)
            value, at = (m[0], m.end()) if m else ("", at)
        if name in ("class", "id", "role"):
            names.append(value)


class Page:
    """The state of reading one page."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[int] = []  # the element that makes a block SIDE, by number
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.open: list[tuple[str, int, int]] = []  # tag, mark with all around it, element that made it SIDE
        self.block_tags: list[int] = []  # places of block-level tags in open
        self.count: Counter = Counter()
        self.number = 0
        self.heading = False

    def take(self, text: str) -> None:
        self.pieces.append(text)
        if self.count["a"]:
            self.linked.append(text)

    def flush(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self.pieces))).strip()
        if text:
            words, links = len(text.split()), len(html.unescape(" ".join(self.linked)).split())
            _, mark, part = self.open[-1] if self.open else ("", PLAIN, 0)
            self.blocks.append(Block(text, words, min(1.0, links / words), mark, self.heading))
            self.parts.append(part)
        self.pieces.clear()
        self.linked.clear()

    def push(self, tag: str, own: int) -> None:
        _, around, part = self.open[-1] if self.open else ("", PLAIN, 0)
        if tag == "header" and around == MAIN:
            own = PLAIN
        if own == PLAIN or around == FAR_SIDE:
            own = around
        elif own == SIDE and around != SIDE:
            self.number += 1
            part = self.number
        if tag in BLOCK_TAGS:
            self.block_tags.append(len(self.open))
        self.open.append((tag, own, part))
        self.count[tag] += 1

    def pop(self) -> str:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        if self.block_tags and self.block_tags[-1] == len(self.open):
            self.block_tags.pop()
        return tag

    def close(self, tag: str) -> None:
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def start(self, tag: str, mark: int) -> None:
        for before in ("p", "li") if tag == "li" else ("p",) if tag in BLOCK_TAGS else ():  # these end with the next block
            if self.block_tags and self.open[self.block_tags[-1]][0] == before:
                self.close(before)
        self.push(tag, mark)

    def finished(self) -> list[Block]:
        self.flush()
        words: Counter = Counter()
        for b, part in zip(self.blocks, self.parts, strict=True):
            if b.mark == SIDE:
                words[part] += b.words
        most = sum(b.words for b in self.blocks) / 2
        # what holds most of the words is no surroundings
        return [b._replace(mark=PLAIN) if b.mark == SIDE and words[part] > most else b for b, part in zip(self.blocks, self.parts, strict=True)]


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    page, read, at = page or "", Page(), 0
    while 0 <= at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            read.take(page[at:])
            break
        if begin > at:
            read.take(page[at:begin])
        m = OPEN.match(page, begin)
        if not m:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 2)
                at = end + 3 if end >= 0 else -1
            elif page[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = page.find(">", begin) + 1 or -1
            else:
                read.take("<")
                at = begin + 1
            continue
        tag, closing = m[2].lower(), bool(m[1])
        at, names, closed = tag_end(page, m.end())
        if at < 0:
            break
        if tag in RAW_TAGS and not closing:
            if tag == "title":
                read.flush()
            close = RAW_TAGS[tag].search(page, at)
            at = tag_end(page, close.end())[0] if close else -1
        elif tag == "br":
            read.take(" ")
        else:
            if tag in BLOCK_TAGS:
                read.flush()
                read.heading = tag in HEADINGS and not closing
            if closing:
                read.close(tag)
            elif tag not in VOID_TAGS and not closed:
                read.start(tag, mark_of(tag, names))
    return read.finished()


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of the one before, itself and the one after; heading; reads like a notice;
    after a heading of comments; surroundings; in the article; the page has an article."""
    if not blocks:
        return np.zeros((0, 12))
    words = np.array([0, *(b.words for b in blocks), 0], "f8")
    links = np.array([0, *(b.link_density for b in blocks), 0], "f8")
    comments = np.cumsum([b.mark != MAIN and bool(COMMENTS.match(b.text)) for b in blocks]) > 0
    flags = np.array([(b.heading, b.words < 40 and bool(NOTICE.search(b.text)), c, b.mark >= SIDE, b.mark == MAIN) for b, c in zip(blocks, comments, strict=True)], "f8")
    marked = np.full((len(blocks), 1), float(any(b.mark == MAIN for b in blocks)))
    return np.column_stack([words[:-2], words[1:-1], words[2:], links[:-2], links[1:-1], links[2:], flags, marked])


class Tree:
    """A CART tree on Gini impurity, as nested tuples (feature, cut, low, high) or a share of positives."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1):
        self.root = self._grow(x, y, depth, least)

    @classmethod
    def _grow(cls, x, y, depth, least):
        if depth == 0 or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in range(x.shape[1] - 1, -1, -1):  # marks of the page come last and win ties
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                if min(low.sum(), (~low).sum()) >= least:
                    impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, float(cut), low)
        if best is None:
            return float(y.mean())
        _, f, cut, low = best
        return f, cut, cls._grow(x[low], y[low], depth - 1, least), cls._grow(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, float):
                out[rows] = node
            elif len(rows):
                f, cut, low, high = node
                below = x[rows, f] < cut
                todo += [(low, rows[below]), (high, rows[~below])]
        return out


#: Pages read at a time: so many rows, and about so many bytes.
PIECE_ROWS, PIECE_BYTES = 500, 8 << 20


def fit(pages: list[tuple[str, str]] = PAGES) -> Tree:
    x, y = [], []
    for page, marks in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(marks):
            raise ValueError(f"{len(marks)} marks for {len(blocks)} blocks: {page[:80]}")
        x.append(features_of(blocks))
        y += [m == "+" for m in marks]
    return Tree(np.concatenate(x), np.array(y, "f8"))


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page)
    keep = tree.predict(features_of(blocks)) >= 0.5
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text) of ``pages`` (page_id, url, html)."""
    tree = tree or fit()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES, "html"):
                texts = pa.array([main_text(x, tree) for x in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, "page_id long, url string, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op10_html_text": op10_html_text}
SQL: dict[str, str] = {}
