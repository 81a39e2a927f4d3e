"""Main text of a web page by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand (plain, in a
link, in a part of the page that is not the article), tags by name, all below 0. One
linear scan finds the contiguous region of the greatest sum; it is widened to whole
blocks, or to the article element around it, and its words become the text, without those
of parts named as something else.

The weights are learned from labelled pages: a page with one ``article`` element
labels its own region. Starting from round figures, a structured perceptron with a
margin moves the weights until the labelled region beats every other by its number of
wrong words.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import by_bytes, plain_texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements of HTML by what they do to the text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong "
             "sub sup time tt u var wbr".split())
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre br hr figure figcaption dd dt dl".split())
OTHER_PARTS = set("head title nav footer aside form menu dialog button select textarea".split())
OTHER_NAMES = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies disclaimer footer masthead menu modal nav navbar navigation newsletter notice "
                  "notification popup promo promotion recommended related search share sharing sidebar signup social "
                  "sponsor sponsored subscribe toolbar widget".split())
MAIN = set("html body main article".split())

#: Where the weights start: a tag by its kind, a word by its place.
START = {"word": 1.0, "word in link": -0.5, "word elsewhere": -0.05,
         "inline": -0.05, "block": -0.2, "item": -0.3, "container": -3.0, "part": -3.0, "main": -40.0}
LEAST_TAG = -0.01                         # tags stay below 0


def _kind(name: str) -> str:
    if name in MAIN:
        return "main"
    if name in OTHER_PARTS or name == "header":
        return "part"
    if name in INLINE:
        return "inline"
    if name in TEXT_BLOCKS:
        return "block"
    return "item" if name in ("li", "ul", "ol", "td", "tr", "th", "table", "tbody") else "container"


def start_weight(feature: str) -> float:
    return START[feature] if feature in START else START[_kind(feature.lstrip("/"))]


@dataclass
class Page:
    """A page's tokens: ``(feature, count, block, text)``; a tag counts 1 and has no text."""

    tokens: list = field(default_factory=list)
    articles: list = field(default_factory=list)          # spans of the outermost article elements


class _Reader:
    """Whether a place is in a link or in a part that is not the article.

    Without ``parts``, such parts are not known, and tags alone part a page."""

    def __init__(self, parts: bool = True):
        self.parts = parts
        self.part = ""                    # the open part that is not the article
        self.depth = 0                    # open elements of its name
        self.link = False
        self.articles = 0

    def place(self) -> str:
        return "word elsewhere" if self.part else "word in link" if self.link else "word"

    def _other(self, name: str, rest: str) -> bool:
        if not self.parts:
            return name in ("head", "title")
        if name in OTHER_PARTS or (name == "header" and not self.articles):
            return True
        if name in MAIN or "=" not in rest:
            return False
        for values in _NAMED.findall(rest):
            if not OTHER_NAMES.isdisjoint(re.split(r"[^a-z]+", "".join(values).lower())):
                return True
        return False

    def tag(self, name: str, closes: bool, rest: str) -> None:
        if name == "a":
            self.link = not closes
        elif name == "article" and not self.part:
            self.articles = max(0, self.articles + (-1 if closes else 1))
        if name in VOID or rest.endswith("/") and name not in OTHER_PARTS:
            return
        if self.part:
            if name == self.part:
                self.depth += -1 if closes else 1
                if not self.depth:
                    self.part = ""
        elif not closes and self._other(name, rest):
            self.part, self.depth = name, 1


def read_page(source: str, parts: bool = True) -> Page:
    """The words and tags of a page in order, in one scan. Comments, scripts and styles
    are none of them; character references are decoded after the tags are known."""
    page, reader = Page(), _Reader(parts)
    block = at = 0
    opened = None

    def words(text: str) -> None:
        if text:
            text = html.unescape(text)
            page.tokens.append((reader.place(), len(text.split()), block, text))

    for m in _TOKEN.finditer(source):
        words(source[at:m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, closes = name.lower(), bool(m["close"])
        if name == "br":
            page.tokens.append((name, 1, block, " "))
            continue
        outer = reader.articles
        reader.tag(name, closes, m["rest"])
        if name not in INLINE:
            block += 1
        page.tokens.append((("/" if closes else "") + name, 1, block, ""))
        if not outer and reader.articles:
            opened = len(page.tokens)
        elif outer and not reader.articles:
            page.articles.append((opened, len(page.tokens) - 1))
            opened = None
    words(source[at:])
    if opened is not None:
        page.articles.append((opened, len(page.tokens)))
    return page


def is_word(feature: str) -> bool:
    return feature.startswith("word")


def best_region(scores: list[float]) -> tuple[int, int]:
    """``(start, end)`` of the contiguous run of greatest sum, in one scan; the first
    among equals, and empty if none is above 0."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


class Weights(dict):
    """Weights by feature; one that no labelled page has keeps its starting figure."""

    def __missing__(self, feature: str) -> float:
        return start_weight(feature)

    def scores(self, page: Page) -> list[float]:
        return [self[f] * n for f, n, _, _ in page.tokens]


def fit_weights(pages: list[Page], rounds: int = 30, step: float = 0.02) -> Weights:
    """Structured perceptron with a margin over pages with one labelled region each.

    A page's rival is the region that scores best when each word that it has wrong adds
    1; the weights move from the rival to the label, by features counted per word of the
    page, until no page has a rival or ``rounds`` are over."""
    weights = Weights()
    for _ in range(rounds):
        wrong = 0
        for page in pages:
            a, b = page.articles[0]
            scores = weights.scores(page)
            gold = sum(scores[a:b])
            # what a region gains by a word outside the label, or loses by one inside;
            # words elsewhere are in no text, so they are never wrong
            for i, (f, n, _, _) in enumerate(page.tokens):
                if is_word(f) and f != "word elsewhere":
                    scores[i] += -n if a <= i < b else n
            lost = sum(n for f, n, _, _ in page.tokens[a:b] if is_word(f) and f != "word elsewhere")
            x, y = best_region(scores)
            if sum(scores[x:y]) + lost <= gold + 1e-9:
                continue
            wrong += 1
            change: Counter = Counter()
            for f, n, _, _ in page.tokens[a:b]:
                change[f] += n
            for f, n, _, _ in page.tokens[x:y]:
                change[f] -= n
            size = sum(map(abs, change.values())) or 1
            for f, n in change.items():
                weights[f] = weights[f] + step * max(1.0, size ** 0.5) * n / size
                if not is_word(f):
                    weights[f] = min(weights[f], LEAST_TAG)
            weights["word"] = max(weights["word"], 0.1)
        if not wrong:
            break
    return weights


def main_text(source: str, weights: Weights) -> str:
    """The blocks of the best region, joined by two newlines. A region within an article
    element grows to the whole element, any other to whole blocks."""
    page = read_page(source)
    a, b = best_region(weights.scores(page))
    if a == b:
        return ""
    a, b = next(((x, y) for x, y in page.articles if x <= a and b <= y), (a, b))
    first, last = page.tokens[a][2], page.tokens[b - 1][2]
    blocks: dict[int, list[str]] = {}
    for f, _, block, text in page.tokens:
        if text and first <= block <= last and f != "word elsewhere":
            blocks.setdefault(block, []).append(text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def learn(pages: DataFrame, html_col: str = "html", sample: int = 400) -> Weights:
    """Weights from at most ``sample`` pages that label their region by one article
    element, those of least hash; without such pages, the starting figures."""
    labelled = pages.select(F.col(html_col).alias("html")).where(F.lower("html").contains("<article"))
    some = labelled.orderBy(F.xxhash64("html"), "html").limit(sample).toArrow()       # bounded by ``sample``
    # each page also as if its other parts had no telling names, so that tags learn to part them
    read = [read_page(h, parts) for h in some["html"].to_pylist() for parts in (True, False)]
    return fit_weights([p for p in read if len(p.articles) == 1])


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row, in one pass.

    A null or empty page, and one without a region above 0, has an empty text. Unclosed
    elements and cut pages are read to their end; a null id or url stays null; repeated
    rows each come back; an empty table gives no rows; other columns are not read.
    """
    if weights is None:
        weights = learn(pages, html_col)
    fitted = dict(weights)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Weights(fitted)
        for batch in by_bytes(batches, "html"):
            texts = [main_text(h, mine) for h in plain_texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
