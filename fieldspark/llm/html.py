"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into text blocks at block-level tags. A block's features are its word count and link density, those of its
neighbours, and what surrounds it (an article, a heading, a container that its tag, class, id or role names as
boilerplate). A small decision tree, trained on the labelled table below, decides. Scripts, styles, forms and the like never
become text.

A null or empty page gives the empty text. Quotes count within an attribute's value alone, so a stray one swallows nothing;
from a tag on whose quotes would swallow the rest of the page, they count no more. Time is linear in the page, however broken.
Pages of any length are read whole. One row out for each row in, repeated rows too; null ids pass through; other columns are
not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import table

#: A tag without regard to quotes: all that is left to try once quotes have led to the end of the page.
PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option datalist button textarea form fieldset label input dialog menu".split())
#: Of these the content is raw: the end tag alone ends it.
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that end a block.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: This library's own choice: elements and names that mark boilerplate.
ASIDE = frozenset("nav footer aside".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|foot|masthead|site-header|header|topbar|sidebar|side|aside|widget|related|recommended|share|sharing|social|"
    r"ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|form|"
    r"comment|comments|comment-list|replies|reply|respond|disqus|discussion|contentinfo|complementary|toc|pagination|pager|tags|meta|byline|copyright|legal|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
#: A header within an article is the article's own.
HEADER = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body)(?:$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boilerplate", "heading", "list")


class Block:
    __slots__ = ("parts", "linked", "article", "bad", "heading", "item")

    def __init__(self, article: int, bad: int, heading: int, item: int):
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.article, self.bad, self.heading, self.item = article, bad, heading, item


def blocks(page: str) -> list[tuple[str, float, int, int, int, int]]:
    """Text, link density, in an article, in boilerplate, heading, list item, of every block in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements: name, article, boilerplate, silent
    now: Block | None = None
    links = 0
    at, end = 0, len(page)
    open_now: dict[str, int] = {}  # open elements by name, so that a stray end tag isn't looked for
    last = page.rfind(">")
    quoted = True  # until a tag's quotes lead to the end of the page

    def find(at: int) -> re.Match | None:
        """The next tag or comment. Every place is passed once, but for one tag that never ends."""
        nonlocal quoted
        at = page.find("<", at)
        while at >= 0:
            nxt = page[at + 1 : at + 2]
            if nxt == "!" or nxt == "?":
                m = TAG.match(page, at)
            elif at > last or not (nxt == "/" or nxt.isascii() and nxt.isalpha()):
                m = None  # nothing that ends, or no tag
            else:
                m = TAG.match(page, at) if quoted else None
                if not m:
                    m = PLAIN.match(page, at)
                    quoted = quoted and not m
            if m:
                return m
            at = page.find("<", at + 1)
        return None

    def close(k: int) -> None:
        for element in stack[k:]:
            open_now[element[0]] -= 1
        del stack[k:]

    def add(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            article, bad = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            names = [s[0] for s in stack[-6:]]
            now = Block(article, bad, int(any(len(n) == 2 and n[0] == "h" and n[1].isdigit() for n in names)), int("li" in names or "td" in names))
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked.append(text)

    while at < end:
        m = find(at)
        if not m:
            if not (stack and stack[-1][3]):
                add(entities.unescape(page[at:]))
            break
        if m.start() > at and not (stack and stack[-1][3]):
            add(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            now = None
        if name == "br":
            add(" ")
        if m[1]:
            if open_now.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            if name == "a":
                links = max(0, links - 1)
            continue
        if name in VOID:
            continue
        if name in RAW:
            raw_end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = raw_end.end() if raw_end else end
            continue
        if name in ("p", "li", "tr", "td", "th", "dd", "dt", "option"):  # their end tags may be left out
            reach = {"p": "p", "li": "li", "tr": "tr td th", "td": "td th", "th": "td th", "dd": "dd dt", "dt": "dd dt"}.get(name, name).split()
            for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                if stack[k][0] in reach:
                    close(k)
                    break
                if stack[k][0] in BLOCK and stack[k][0] != "p":
                    break
        named = " ".join(x or y or z for x, y, z in NAMED.findall(m[3])) if m[3] else ""
        _, article, bad, silent = stack[-1] if stack else ("", 0, 0, 0)
        if name in ("article", "main") or named and name != "body" and MAIN.search(named) and not HINTS.search(named):
            article = 1
        if name in ASIDE or name == "header" and not article or named and name not in ("article", "main", "body", "html") and HINTS.search(HEADER.sub("", named) if article else named):
            bad = 1
        open_now[name] = open_now.get(name, 0) + 1
        stack.append((name, article, bad, int(silent or name in SILENT or "hidden" in m[3].split())))
        if name == "a":
            links += 1
    done = []
    for b in out:
        text = SPACE.sub(" ", "".join(b.parts)).strip()
        if text:
            linked = len(SPACE.sub(" ", "".join(b.linked)).strip())
            done.append((text, min(1.0, linked / len(text)), b.article, b.bad, b.heading, b.item))
    return done


def features(found: list[tuple[str, float, int, int, int, int]]) -> np.ndarray:
    """A row of FEATURES for each block."""
    n = len(found)
    words = np.array([len(b[0].split()) for b in found], float)
    links = np.array([b[1] for b in found], float)
    zero = np.zeros(1)
    shape = np.array([b[2:] for b in found], float).reshape(n, 4)
    return np.column_stack([words, links, np.r_[zero, words[:-1]], np.r_[zero, links[:-1]], np.r_[words[1:], zero], np.r_[links[1:], zero], shape]) if n else np.empty((0, len(FEATURES)))


#: The labelled table, this library's own: FEATURES in order, then 1 for main text.
LABELLED = """
  1 1.0   0 0.0   1 1.0  0 1 0 1  0
  2 1.0   1 1.0   1 1.0  0 1 0 1  0
  3 1.0   2 1.0   8 0.0  0 1 0 1  0
  8 0.0   3 1.0   9 0.0  0 1 0 0  0
 12 0.0   1 1.0  10 0.0  0 1 0 0  0
 30 0.0   9 0.0  12 0.0  0 1 0 0  0
 60 0.1  40 0.0   5 0.0  0 1 0 0  0
  9 0.2  80 0.0   0 0.0  0 1 0 0  0
 14 0.0  60 0.0   0 0.0  0 1 0 0  0
  4 0.0  14 0.0  20 0.0  1 1 0 0  0
 25 0.0  60 0.0  18 0.0  1 1 0 0  0
 40 0.0  25 0.0  35 0.0  1 1 0 0  0
  6 0.9  50 0.0   5 0.9  1 1 0 1  0
  3 0.0  70 0.0  30 0.0  1 1 1 0  0
 11 0.0   8 0.0  70 0.0  1 0 1 0  1
  7 0.0   4 0.0  20 0.0  1 0 1 0  1
 55 0.0  11 0.0  40 0.0  1 0 0 0  1
  2 0.0  55 0.0  40 0.0  1 0 0 0  1
  1 0.0   2 0.0   9 0.0  1 0 0 0  1
 90 0.1   2 0.0  12 0.2  1 0 0 0  1
 35 0.4  90 0.1  50 0.0  1 0 0 0  1
 12 0.0  35 0.0   8 0.0  1 0 0 1  1
  5 0.3  12 0.0   9 0.0  1 0 0 1  1
  3 1.0  40 0.0  45 0.0  1 0 0 0  1
  2 0.0  30 0.0   1 0.0  1 0 0 0  1
  1 0.0   2 0.0   0 0.0  1 0 0 0  1
  3 0.0   0 0.0   2 0.0  1 0 0 0  1
 22 0.0   3 0.0   0 0.0  1 0 0 0  1
  5 0.0  22 0.0   3 0.0  1 0 1 0  1
  4 0.0   1 1.0   2 1.0  1 0 0 0  1
  2 1.0   3 1.0   1 1.0  1 0 0 1  1
  9 0.0   1 1.0   6 0.0  1 0 1 0  1
  6 0.0   9 0.0   5 1.0  1 0 0 0  1
 14 0.0   4 0.0   7 0.0  1 0 0 1  1
  1 0.0  14 0.0   4 0.9  1 0 0 0  1
 70 0.0   1 0.0   2 1.0  1 0 0 0  1
  6 0.0   1 1.0  60 0.0  0 0 1 0  1
 38 0.0  60 0.0   0 0.0  0 0 0 0  1
 27 0.0  18 0.0   3 1.0  0 0 0 0  1
 16 0.1   6 0.0  20 0.0  0 0 0 0  1
  8 0.0  27 0.0  16 0.0  0 0 0 0  1
 60 0.0   2 0.0  50 0.0  0 0 0 0  1
 45 0.0   1 1.0   3 0.0  0 0 0 0  1
 50 0.0   3 0.0   0 0.0  0 0 0 0  1
 20 0.1   2 1.0  15 0.0  0 0 0 0  1
 12 0.0   0 0.0  30 0.0  0 0 0 0  1
 60 0.0   6 0.0  45 0.0  0 0 0 0  1
 45 0.1  60 0.0  30 0.0  0 0 0 0  1
 30 0.0  45 0.1   4 0.0  0 0 0 0  1
 18 0.0  30 0.0  40 0.1  0 0 0 0  1
  8 0.0  50 0.0  60 0.0  0 0 0 0  1
 10 0.0  60 0.0  35 0.0  0 0 0 0  1
  2 1.0   2 1.0   3 1.0  0 0 0 0  0
  3 0.9   1 1.0   2 1.0  0 0 0 1  0
 12 0.8   3 1.0   4 1.0  0 0 0 0  0
 20 0.7   2 1.0   0 0.0  0 0 0 1  0
  2 0.0   1 1.0   1 1.0  0 0 0 0  0
  3 0.0   2 1.0   0 0.0  0 0 0 0  0
  5 0.0   0 0.0   2 1.0  0 0 0 0  0
  6 0.0   0 0.0   1 1.0  0 0 1 0  0
  4 0.0   3 1.0   2 1.0  0 0 0 1  0
  3 0.0  50 0.0  40 0.0  0 0 0 0  0
  2 0.0  40 0.0  60 0.0  0 0 0 0  0
  7 0.6   1 1.0  25 0.0  0 0 0 0  0
  1 1.0   1 1.0  40 0.0  0 0 0 0  0
  2 1.0  35 0.0   2 1.0  0 0 0 1  0
  3 0.0   3 0.0   2 0.0  0 0 0 0  0
"""


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.share = float(y.mean()) if len(y) else 0.0
        self.at: tuple[int, float] | None = None
        if depth == 0 or self.share in (0.0, 1.0):
            return
        best = 1e9
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= cut
                cost = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
                if cost < best - 1e-12:
                    best, self.at = cost, (f, float(cut))
        if self.at:
            left = x[:, self.at[0]] <= self.at[1]
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.at is None:
            return np.full(len(x), self.share >= 0.5)
        low, high = self.low.predict(x), self.high.predict(x)
        return np.where(x[:, self.at[0]] <= self.at[1], low, high)


@lru_cache(maxsize=1)
def trained() -> Tree:
    rows = np.array([r.split() for r in LABELLED.strip().splitlines()], float)
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None) -> str:
    """Blocks of main text, joined by line breaks."""
    if not page:
        return ""
    found = blocks(page)
    keep = trained().predict(features(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, and text."""
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = rows.select(*keep, F.col("html").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(p) for p in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], text], [*keep, "text"])

    return rows.mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text and its length of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
