"""Main text of web pages by the distribution of text over lines.

A page is stripped of markup into lines, one per block element; menus, forms, adverts,
comments and the like are markup too and leave no line. A line weighs its characters, or
nothing where most of them are links or a name in the markup speaks against it. Weights of
a sliding window of lines are summed. The text begins at the line where a sum surges from
nothing and ends at the one where the sums dive to nothing again; it counts if some sum in
between reaches `SURGE` characters, or `PEAK` of the page's highest sum. All lines from surge to dive stay,
lists of links and lines with odd names among them.

Where a page marks its article, a text that meets the mark is as long as the mark: no
line of it is lost however thin it is, and lines beside it go. Marks that hold but teasers are told
by the same sums: with `TEASERS` times their weight in texts outside, those are taken.

Names are taken by whole class tokens: `ad-slot` is an advert and goes, `has-sidebar` says
nothing, and `share-price` is a hint only, which takes the line its weight.

Defined results: a null or empty page, and one without text, has an empty text; an
element left open ends with its parent or at the tag that implies its end; an unclosed
comment, script or tag reaches to the end; a quote counts only where a value begins; other
columns pass through; empty tables give no rows. Every page is read in time linear in its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines in a window; the sum of one that makes a text, in characters or as a share of the
# page's highest; how much more text outside an article's marks makes them teasers.
WINDOW = 3
SURGE = 80
PEAK = 0.3
TEASERS = 8

# Possessive, so that what was read is never read again from the same place.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe)(?=[\s/>]){ATTRIBUTES}(?:>|\Z)"
    r".*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>{ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
PARTS = re.compile(r"[^a-z]+")

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
AWAY = frozenset(
    "aside button datalist dialog fieldset footer form head input menu nav object optgroup option "
    "select svg".split()
)
ARTICLE = frozenset(("article", "main"))
# An open paragraph ends where one of these begins.
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "head"}
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"),
               "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
# Words in class, id and role of what is not the article.
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment "
    "comments consent contentinfo complementary cookie cookies disqus footer gdpr login menu modal "
    "nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted "
    "promotion related search share sharing sidebar sidebars signup social sponsor sponsored "
    "subscribe subscription toc toolbar widget".split()
)
OUTSIDE_NAMES = frozenset("header masthead topbar".split())
# Parts that may stand beside such a word in one class token, and first parts that
# make a token tell of something else than the element itself.
BESIDE = frozenset(
    "area bar block body bottom box button buttons container content count form group inner item items left "
    "link links list main outer page post posts right section site slot text thread title top "
    "unit wrap wrapper".split()
)
OF_OTHERS = frozenset("has no with without is hide hidden show not".split())


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    in_article: bool = False
    away: bool = False
    doubtful: bool = False

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


STAYS, DOUBTFUL, GOES = range(3)


def evidence(tag: str, attributes: str, in_article: bool) -> int:
    """What an element's name and the tokens of its class, id and role say of it."""
    if tag in AWAY or (tag == "header" and not in_article):
        return GOES
    if "=" not in attributes:
        return STAYS
    words = AWAY_NAMES if in_article else AWAY_NAMES | OUTSIDE_NAMES
    if tag in ("html", "body", "article", "main"):
        words = frozenset(("comment", "comments"))
    found = STAYS
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() not in ("class", "id", "role"):
            continue
        for token in "".join(values).lower().split():
            parts = [part for part in PARTS.split(token) if part]
            if not parts or parts[0] in OF_OTHERS or words.isdisjoint(parts):
                continue
            if all(part in words or part in BESIDE for part in parts):
                return GOES
            found = DOUBTFUL
    return found


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; those of boilerplate are marked, not left out."""
    lines = [Line()]
    # Open elements: name, whether they are boilerplate, doubtful, the article.
    stack: list[tuple[str, bool, bool, bool]] = []
    opened: Counter[str] = Counter()
    away = doubtful = article = links = 0

    def new_line() -> None:
        if lines[-1].parts:
            lines.append(Line())

    def pop_to(depth: int) -> None:
        nonlocal away, doubtful, article, links
        while len(stack) > depth:
            name, was_away, was_doubtful, was_article = stack.pop()
            opened[name] -= 1
            away -= was_away
            doubtful -= was_doubtful
            article -= was_article
            links -= name == "a"
            if name in BLOCKS or was_away or was_doubtful:
                new_line()

    def find_open(name: str, within: tuple[str, ...] = ()) -> int:
        if not opened[name]:
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                return i
            if stack[i][0] in within:
                break
        return -1

    def add(text: str) -> None:
        if not text:
            return
        line = lines[-1]
        marks = away > 0, doubtful > 0, article > 0
        if line.parts and line.away != marks[0]:
            new_line()
            line = lines[-1]
        if not line.parts:
            line.away, line.doubtful, line.in_article = marks
        line.parts.append(text)
        line.size += len(text)
        if links:
            line.linked += len(text)

    at = 0
    for match in TOKEN.finditer(page):
        add(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if not tag:
            if match["raw"] or not match[0].startswith("<!--"):
                new_line()
            continue
        if match["end"]:
            if tag == "br" or tag == "p" and find_open("p") < 0:
                new_line() if tag == "p" else add(" ")
                continue
            place = find_open(tag)
            if place >= 0:
                pop_to(place)
            elif tag in BLOCKS:
                new_line()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "body":
            pop_to(0)
        if tag in ENDS_PARAGRAPH:
            place = find_open("p", ("article", "main", "section", "div", "td", "li", "body"))
            if place >= 0:
                pop_to(place)
        if tag in CLOSES_SAME:
            place = find_open(tag, CLOSES_SAME[tag])
            if place >= 0:
                pop_to(place)
        if tag in BLOCKS:
            new_line()
        if tag in VOID or match["attributes"].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in ARTICLE and away and all(e[0] == "form" for e in stack if e[1]):
            # A form around the whole page is its frame.
            new_line()
            stack[:] = [(name, False, *marks) for name, _, *marks in stack]
            away = 0
        said = evidence(tag, match["attributes"], article > 0)
        stack.append((tag, said == GOES, said == DOUBTFUL, tag in ARTICLE))
        opened[tag] += 1
        away += said == GOES
        doubtful += said == DOUBTFUL
        article += tag in ARTICLE
        links += tag == "a"
        if said != STAYS:
            new_line()
    add(page[at:])
    return lines


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of lines from a surge of the window sums to their dive, if one sum between is high enough."""
    if not weights.any():
        return []
    padded = np.concatenate((np.zeros(WINDOW - 1), weights, np.zeros(WINDOW - 1)))
    sums = np.convolve(padded, np.ones(WINDOW), mode="valid")
    filled = np.concatenate(([0], (sums > 0).astype(np.int8), [0]))
    surges, dives = np.flatnonzero(np.diff(filled) == 1), np.flatnonzero(np.diff(filled) == -1)
    level = min(SURGE, PEAK * sums.max())
    # Window `i` ends with line `i`: the first one above nothing ends with the first line of
    # the text, the last one begins with the last line.
    return [
        (int(surge), int(dive) - WINDOW + 1)
        for surge, dive in zip(surges, dives, strict=True)
        if sums[surge:dive].max() >= level
    ]


def main_text(page: str | None) -> str:
    read = ((line, line.text()) for line in lines_of(page or "") if not line.away)
    # A line of nothing but markup and white space is no line.
    lines = [(line, text) for line, text in read if text]
    marks = np.array([line.in_article for line, _ in lines], dtype=bool)
    weights = np.array(
        [
            len(text) if line.in_article
            else 0 if line.doubtful or 2 * line.linked >= line.size
            else len(text)
            for line, text in lines
        ],
        dtype=np.float64,
    )
    inside = stretches(np.where(marks, weights, 0))
    outside = stretches(np.where(marks, 0, weights))
    marked = weights[marks].sum()
    if marked and sum(weights[a:b].sum() for a, b in outside) < TEASERS * marked:
        # The text met by the sums reaches as far as the marks do.
        kept = np.flatnonzero(marks) if inside else []
    else:
        kept = [i for a, b in outside for i in range(a, b) if not marks[i]]
    return "\n\n".join(lines[i][1] for i in kept)


def extract(column: str):
    """For `mapInArrow`: `row` and the main text of its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = [main_text(page) for page in row.field(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], names=["row", "text"])

    return run


def main_texts(pages: DataFrame, column: str = "html") -> DataFrame:
    """`row` (struct of all columns) and text of every page."""
    rows = pages.select(F.struct("*").alias("row"))
    return rows.mapInArrow(extract(column), f"row {rows.schema['row'].dataType.simpleString()}, text string")
