"""Markup, entity and token expressions. All stay in the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from lectern.functions.markup import Wanted, spans, without

REFERENCE = r"&(?:#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);?"
# Names as the standard library has them, with their characters, and the numbers 128 to 159,
# which pages mean as Windows characters.
NAMES = {name: char for name, char in html5.items()} | {
    f"#{n}": bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)
}

# Tags that end a block of text.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|"
    "head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
)

# Elements that show a video, and the classes of adverts and of users' comments.
VIDEO_TAGS = ("iframe", "video", "object", "embed")
AD_CLASSES = ("ad", "ads", "advert", "advertisement")
COMMENT_CLASSES = ("comments",)

UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ARTICLE = r"(?is)<article\b[^>]*>(.*)</article\s*>"
NOT_SHOWN = ("comment", "script", "style")
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
HEADING = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
TAG = r"<[^>]*>"
WORD = r"[\p{L}\p{N}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_unseen(html: str | Column) -> Column:
    """Without HTML comments, scripts and styles, whose content may look like tags."""
    return F.regexp_replace(_col(html), UNSEEN, " ")


def _decoded(reference: Column, names: Column, bare: bool) -> Column:
    """The character of one reference, or the reference itself if there is none."""
    body = F.regexp_replace(reference, "^&|;$", "")
    closed = reference.endswith(";")
    digits = F.regexp_extract(body, "^#([0-9]+)$", 1)
    hexadecimal = F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]+)$", 1)
    code = F.when(digits != "", F.try_to_number(F.right(digits, F.lit(18)), F.lit("9" * 18)).cast("bigint")).when(
        (hexadecimal != "") & (F.length(hexadecimal) < 15), F.conv(hexadecimal, 16, 10).cast("bigint")
    )
    impossible = (code == 0) | (code > 0x10FFFF) | ((code >= 0xD800) & (code <= 0xDFFF)) | (code.isNull())
    number = F.coalesce(
        F.try_element_at(names, F.concat(F.lit("#"), code.cast("string"))),
        F.when(impossible, "\uFFFD").otherwise(
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        ),
    )
    # Only names that HTML also reads without a semicolon are in the table without one.
    named = F.try_element_at(names, F.when(closed, F.concat(body, F.lit(";"))).otherwise(body))
    found = F.when(body.startswith("#"), number).otherwise(named)
    return F.coalesce(found if bare else F.when(closed, found), reference)


def decode_entities(text: str | Column, bare: bool = True) -> Column:
    """Character references decoded once, from left to right, so that `&amp;lt;` becomes `&lt;`.

    With `bare`, also references without their semicolon, as in text but not in attributes.
    Text without `&` is left alone.
    """
    text = _col(text)
    names = F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")
    parts = F.arrays_zip(
        F.split(text, REFERENCE, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("reference"),
    )
    decoded = F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(
                p["gap"], F.coalesce(_decoded(p["reference"], names, bare), F.lit(""))
            ),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def squeeze(text: str | Column) -> Column:
    """Runs of white space, also of the kind that doesn't break, as one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"[ \t\r\n\f\xA0]+", " "))


def plain_text(markup: str | Column) -> Column:
    """Visible text of markup that holds no scripts, styles or comments."""
    return squeeze(decode_entities(F.regexp_replace(_col(markup), TAG, " ")))


def article_text(html: str | Column, pattern: str = ARTICLE) -> Column:
    """Text inside the first group of `pattern`; empty where the page has no such part."""
    return plain_text(F.regexp_extract(drop_unseen(html), pattern, 1))


def dense_blocks(html: str | Column, min_chars: int = 80, min_density: float = 0.6) -> Column:
    """Text blocks from the first to the last long and dense one, in page order, one per line.

    Short blocks between them belong to the text.
    """
    away = Wanted({"video": VIDEO_TAGS}, {"ad": AD_CLASSES}, unseen=NOT_SHOWN)
    bare = without(html, spans(html, away), spaced=NOT_SHOWN)
    blocks = F.split(bare, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>")

    def measured(block: Column) -> Column:
        # Only inline tags are left, which part no words.
        shown = squeeze(F.regexp_replace(block, TAG, ""))
        chars = F.length(shown)
        dense = (chars >= min_chars) & (chars >= F.length(block) * F.lit(min_density))
        return F.struct(shown.alias("shown"), dense.alias("dense"))

    def between(all_: Column) -> Column:
        flags = F.transform(all_, lambda b: b["dense"])
        first = F.array_position(flags, True)
        last = F.size(flags) - F.array_position(F.reverse(flags), True) + 1
        kept = F.slice(all_, F.greatest(first, F.lit(1)), F.when(first > 0, last - first + 1).otherwise(0))
        kept = F.filter(kept, lambda b: b["shown"] != "")
        return F.array_join(F.transform(kept, lambda b: squeeze(decode_entities(b["shown"]))), "\n")

    # Bound to a variable, so that blocks are measured once.
    return F.get(F.transform(F.array(F.transform(blocks, measured)), between), F.lit(0))


def escape_html(text: str | Column) -> Column:
    """`&` first, so that the references added for `<`, `>` and `"` stay whole."""
    out = F.replace(_col(text), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def first_line(text: str | Column) -> Column:
    """The whole first line, as a title; what shows it may shorten it."""
    return F.substring_index(_col(text), "\n", 1)


def blank_to_null(text: str | Column) -> Column:
    return F.nullif(squeeze(text), F.lit(""))


def tokens(text: str | Column) -> Column:
    """Lower-case words, in order: runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))
