"""Elements of a page by balanced markup, as column expressions.

A page is cut into tags, comments and scripts in one scan, and one pass over these adds up the
depth of every element that is looked for: +1 at a start tag of its name, -1 at an end tag, so
that it ends at its own end tag whatever is nested in it. Nothing leaves the page's row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

# Quotes matter only where a value begins. Possessive, so that nothing is read twice.
REST_OF_TAG = r"""(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s>]*+)?+|["'])*+>"""
ATTRIBUTE = r"""(?s)[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
# Comments and scripts that never end hide the rest of the page.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\z)"
    rf"|</?[a-z][^\s<>/]*+{REST_OF_TAG}"
)
# Elements without an end tag.
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
)
# Elements at whose begin an open paragraph ends.
ENDS_PARAGRAPH = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "dt", "dd", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "table", "ul",
)

OPEN = "array<struct<name:string,kind:string,depth:int,start:int,inner:int>>"
SPANS = "array<struct<start:int,back:int,kind:string,inner:int,last:int>>"


@dataclass(frozen=True)
class Wanted:
    """What to find: kinds of elements by tag name, by any of their classes, or both."""

    names: Mapping[str, Sequence[str]] = field(default_factory=dict)
    classes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    # Kinds of what isn't shown.
    unseen: Sequence[str] = ()


def tags(html: str | Column, name: str) -> Column:
    """All start tags of one name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}(?=[\s/>]){REST_OF_TAG}"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without its quotes; null if it has none."""
    found = F.filter(
        F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?is)^{name}\s*=")
    )
    value = F.regexp_extract(F.get(found, F.lit(0)), r"(?s)=\s*(.*)$", 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def _among(value: Column, kinds: Mapping[str, Sequence[str]], test: Callable) -> Column:
    found = F.lit(None).cast("string")
    for kind, names in reversed(list(kinds.items())):
        found = F.when(test(value, names), F.lit(kind)).otherwise(found)
    return found


def _tokens(html: Column, wanted: Wanted) -> Column:
    """Per token: sizes of the text before it and of itself, its name, its step in depth, its kind."""
    parts = F.arrays_zip(
        F.split(html, TOKEN, -1).alias("gap"),
        F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)).alias("token"),
    )

    def named(p: Column) -> Column:
        token = p["token"]
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s<>/]*)", 1))
        name = F.when(token.startswith("<!--"), F.lit("!--")).otherwise(name)
        return F.struct(
            F.length(p["gap"]).alias("before"),
            F.length(token).alias("size"),
            name.alias("name"),
            token.startswith("</").alias("ends"),
            token.alias("token"),
        )

    def classified(t: Column) -> Column:
        step = (
            F.when(t["ends"], F.lit(-1))
            .when(t["name"].isin("!--", "script", "style", *VOID), F.lit(0))
            .otherwise(F.lit(1))
        )
        unseen = {"!--": "comment", "script": "script", "style": "style"}
        kinds = {kind: [n for n, k in unseen.items() if k == kind] for kind in wanted.unseen} | dict(wanted.names)
        by_name = _among(t["name"], kinds, lambda name, names: name.isin(list(names)))
        by_class = F.lit(None).cast("string")
        if wanted.classes:
            given = F.split(F.lower(attribute(t["token"], "class")), r"\s+")
            found = _among(
                given, wanted.classes, lambda given, names: F.arrays_overlap(given, F.array(*map(F.lit, names)))
            )
            shown = ~t["name"].isin(*unseen) & t["token"].rlike("(?i)class")
            by_class = F.when(shown, found)
        return F.struct(
            t["before"].alias("before"),
            t["size"].alias("size"),
            t["name"].alias("name"),
            step.alias("step"),
            F.when(~t["ends"], F.coalesce(by_name, by_class)).alias("kind"),
        )

    # After the last token there is only text.
    return F.transform(F.transform(F.filter(parts, lambda p: p["token"].isNotNull()), named), classified)


def _span(kind: Column, start: Column, stop: Column, inner: Column, last: Column) -> Column:
    """Spans sort by where they begin, the longer one first."""
    return F.struct(
        start.alias("start"), (-stop).alias("back"), kind.alias("kind"), inner.alias("inner"), last.alias("last")
    )


def spans(html: str | Column, wanted: Wanted) -> Column:
    """Where the wanted elements stand: (start, back = -end, kind, inner, last), by place.

    Places count characters from 0; the content is between `inner` and `last`. An element without
    its end tag is its start tag only, so no text is lost with it.
    """
    html = F.col(html) if isinstance(html, str) else html
    nothing = F.struct(
        F.lit(0).alias("at"),
        F.expr(f"cast(array() as {OPEN})").alias("open"),
        F.expr(f"cast(array() as {SPANS})").alias("spans"),
    )

    def step(seen: Column, t: Column) -> Column:
        start = seen["at"] + t["before"]
        stop = start + t["size"]
        some_open = F.size(seen["open"]) > 0
        moved = F.transform(
            seen["open"],
            lambda o: F.struct(
                o["name"].alias("name"),
                o["kind"].alias("kind"),
                F.when(o["name"] == t["name"], o["depth"] + t["step"]).otherwise(o["depth"]).alias("depth"),
                o["start"].alias("start"),
                o["inner"].alias("inner"),
            ),
        )
        # An open paragraph ends where a block begins.
        implied = (t["step"] == 1) & t["name"].isin(*ENDS_PARAGRAPH)
        over = lambda o: (o["depth"] == 0) | (implied & (o["name"] == "p"))
        ended = F.transform(
            F.filter(moved, over),
            lambda o: F.when(o["depth"] == 0, _span(o["kind"], o["start"], stop, o["inner"], start)).otherwise(
                _span(o["kind"], o["start"], start, o["inner"], start)
            ),
        )
        still = F.when(some_open, F.filter(moved, lambda o: ~over(o))).otherwise(seen["open"])
        done = F.when(some_open, F.concat(seen["spans"], ended)).otherwise(seen["spans"])
        begun = F.struct(
            t["name"].alias("name"), t["kind"].alias("kind"), F.lit(1).alias("depth"), start.alias("start"),
            stop.alias("inner"),
        )
        return F.struct(
            stop.alias("at"),
            F.when(t["kind"].isNotNull() & (t["step"] == 1), F.array_append(still, begun)).otherwise(still).alias("open"),
            F.when(
                t["kind"].isNotNull() & (t["step"] == 0), F.array_append(done, _span(t["kind"], start, stop, start, stop))
            ).otherwise(done).alias("spans"),
        )

    def finish(seen: Column) -> Column:
        unclosed = F.transform(seen["open"], lambda o: _span(o["kind"], o["start"], o["inner"], o["inner"], o["inner"]))
        return F.sort_array(F.concat(seen["spans"], unclosed))

    return F.aggregate(_tokens(html, wanted), nothing, step, finish)


def outermost(found: Column) -> Column:
    """Of sorted spans those that stand in no other one."""
    nothing = F.struct(F.lit(0).alias("stop"), F.expr(f"cast(array() as {SPANS})").alias("kept"))
    return F.aggregate(
        found,
        nothing,
        lambda seen, s: F.when(
            s["start"] >= seen["stop"],
            F.struct((-s["back"]).alias("stop"), F.array_append(seen["kept"], s).alias("kept")),
        ).otherwise(seen),
        lambda seen: seen["kept"],
    )


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def inside(html: Column, span: Column) -> Column:
    """The content of an element."""
    return F.substring(html, span["inner"] + 1, span["last"] - span["inner"])


def without(html: str | Column, found: Column, spaced: Sequence[str] = ()) -> Column:
    """The page without the elements found; those of the kinds `spaced` leave a space."""
    html = F.col(html) if isinstance(html, str) else html

    def cut(away: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(away, lambda s: -s["back"]))
        ends = F.concat(F.transform(away, lambda s: s["start"]), F.array(F.length(html)))
        left = F.concat(
            F.transform(away, lambda s: F.when(s["kind"].isin(*spaced), " ").otherwise("") if spaced else F.lit("")),
            F.array(F.lit("")),
        )
        pieces = F.arrays_zip(begins.alias("begin"), ends.alias("end"), left.alias("left"))
        return F.array_join(
            F.transform(
                pieces, lambda p: F.concat(F.substring(html, p["begin"] + 1, p["end"] - p["begin"]), p["left"])
            ),
            "",
        )

    # Bound to a variable, so that the page is scanned once.
    return F.get(F.transform(F.array(outermost(found)), cut), F.lit(0))
