"""Text of the elements of an HTML page chosen by a selector that may differ per page.

The selector is `tag`, `tag.class`, `tag#id`, `.class` or `#id`. Nested elements
of the same tag are balanced, which a regular expression cannot do.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9]*)?(?:([.#])([\w-]+))?$")
SPACES = re.compile(r"[ \t\r\n\f\xa0]+")
# Elements whose begin ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Elements without an end tag.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)


class _PartText(HTMLParser):
    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        match = SELECTOR.match(selector.strip())
        self.tag, self.kind, self.name = match.groups() if match else ("?", None, None)
        self.open_tag = None
        self.depth = 0
        self.hidden = None
        self.pieces = []

    def _chosen(self, tag, attrs):
        if self.tag and tag != self.tag.lower():
            return False
        if not self.kind:
            return bool(self.tag)
        value = dict(attrs).get("class" if self.kind == "." else "id") or ""
        return self.name in (value.split() if self.kind == "." else [value])

    def handle_starttag(self, tag, attrs):
        if self.open_tag == "p" and tag in ENDS_PARAGRAPH:
            # An open paragraph ends where a block begins.
            self.open_tag, self.depth = None, 0
        if self.open_tag is None:
            if tag not in VOID_TAGS and self._chosen(tag, attrs):
                self.open_tag, self.depth = tag, 1
                self.pieces.append(" ")
            return
        if tag == self.open_tag:
            self.depth += 1
        if tag in ("script", "style"):
            self.hidden = tag
        self.pieces.append(" ")

    def handle_startendtag(self, tag, attrs):
        if self.open_tag is not None:
            self.pieces.append(" ")

    def handle_endtag(self, tag):
        if self.open_tag is None:
            return
        if tag == self.hidden:
            self.hidden = None
        if tag == self.open_tag:
            self.depth -= 1
            if self.depth == 0:
                self.open_tag = None
        self.pieces.append(" ")

    def handle_comment(self, data):
        self.pieces.append(" ")

    def handle_data(self, data):
        if self.open_tag is not None and not self.hidden:
            self.pieces.append(data)


def part_text(html: str | None, selector: str | None) -> str | None:
    """Text of all elements that `selector` names, in order; empty if there is none."""
    if html is None or selector is None:
        return None
    parser = _PartText(selector)
    parser.feed(html)
    parser.close()
    return SPACES.sub(" ", "".join(parser.pieces)).strip(" ")


def selected_text(html: str | Column, selector: str | Column) -> Column:
    """`part_text` over Arrow batches."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series, selectors: pd.Series) -> pd.Series:
        return pd.Series(
            [part_text(page, selector) for page, selector in zip(pages, selectors)], dtype=object
        )

    return extract(html, selector)
