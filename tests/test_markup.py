"""Balanced markup: elements end at their own end tags, wherever they stand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import plan
from lectern.functions import markup as M
from lectern.operators import articles, links


def stripped(spark, *html):
    df = spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string")
    return [tuple(r)[1:] for r in articles.strip_distractions(df).orderBy("page_id").collect()]


def parted(spark, *html):
    df = spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string")
    return [tuple(r)[1:] for r in articles.split_comments(df).orderBy("page_id").collect()]


STRIPPED = {
    '<div class="ad"><div>x</div>BUY NOW</div>keep': ("keep", 0, 0, 1),
    "<div class='ad'>x</div>keep": ("keep", 0, 0, 1),
    '<section class="ad banner">x</section>keep': ("keep", 0, 0, 1),
    "<div class=AD>x</div>keep": ("keep", 0, 0, 1),
    '<div class="adverse" data-class="ad" title="class=ad">x</div>': ('<div class="adverse" data-class="ad" title="class=ad">x</div>', 0, 0, 0),
    "<!-- <script> -->REAL TEXT<script>x</script>end": ("<!-- <script> -->REAL TEXTend", 1, 0, 0),
    '<script>"<div class=ad>"</script>a<div class=ad>b</div>': ("a", 1, 0, 1),
    "<div class=ad><iframe src=x></iframe><div class=ad>y</div></div>z": ("z", 0, 1, 1),
    "<video><object></object></video>a<embed src='x>y'>b": ("ab", 0, 2, 0),
    "<div class=ad>never closed": ("never closed", 0, 0, 1),
    "<p class=ad>buy<p>text<div class=ad>": ("<p>text", 0, 0, 2),
    "</div></div><div class=ad>x</div>y</div>": ("</div></div>y</div>", 0, 0, 1),
    "a < b <div class=ad>x</div> c > d": ("a < b  c > d", 0, 0, 1),
    "<script>open to the end <div class=ad>": ("", 1, 0, 0),
    "<ins class=ad title=it's>x</ins>’é<ins class=ad>x</ins>𝒳y": ("’é𝒳y", 0, 0, 2),
    "": ("", 0, 0, 0),
    "no markup": ("no markup", 0, 0, 0),
}


def test_distractions_end_at_their_own_tags(spark):
    got = stripped(spark, *STRIPPED)
    assert dict(zip(STRIPPED, got)) == STRIPPED


def test_a_page_without_html(spark):
    assert stripped(spark, None)[0][0] is None


PARTED = {
    '<div class="comments"><div>one</div><div>two</div></div>main': ("main", "one two"),
    "a<section class='x comments y'><section>one</section><script>'</section>'</script>two</section>b": ("ab", "one two"),
    "<div class=comments>1</div>x<div class=comments>2 &amp;amp;</div>": ("x", "1\n2 &amp;"),
    "<!-- <div class=comments> -->x": (" x", None),
    "<div class=comments></div>x": ("x", None),
    "<div class=comments>1<div class=comments>2</div>3</div>x": ("x", "1 2 3"),
}


def test_comments_go_as_a_whole(spark):
    assert dict(zip(PARTED, parted(spark, *PARTED))) == PARTED


def balanced(html):
    """The page without adverts, by a stack per element name."""
    out, at, away, depth = [], 0, None, 0
    for m in re.finditer(r"<(/?)(div|b)( class=ad)?>", html):
        if away is None:
            out.append(html[at : m.start()])
            at = m.start()
            if m[3]:
                away, depth = m[2], 1
            continue
        if m[2] == away:
            depth += -1 if m[1] else 1
            if depth == 0:
                away, at = None, m.end()
    return "".join(out) + html[at:]


def closed_tree(rng, depth=0):
    out = []
    for n in range(rng.randrange(4)):
        tag = rng.choice(["div", "b"])
        ad = " class=ad" if rng.random() < 0.3 else ""
        inner = closed_tree(rng, depth + 1) if depth < 5 else ""
        out.append(f"{rng.choice(['', 't', 'é '])}<{tag}{ad}>{n}{inner}</{tag}>")
    return "".join(out) + "."


def test_any_nesting(spark):
    rng = random.Random(2)
    html = [closed_tree(rng) for _ in range(300)]
    assert [r[0] for r in stripped(spark, *html)] == [balanced(h) for h in html]
    assert any(len(h) > 200 for h in html)


@pytest.mark.parametrize(
    "html",
    ["<a " * 60_000, "<div class=ad>" * 500 + "</div>" * 500, '<a b="' * 60_000, "<p>x" * 30_000, "<!--" * 60_000],
)
def test_long_pages_take_linear_time(spark, html):
    # Each of them would take hours if scanned anew from every tag.
    assert len(stripped(spark, html)) == 1


def test_nothing_leaves_its_row(spark):
    df = spark.createDataFrame([(1, "x", "<p>")], "page_id bigint, url string, html string")
    for out in (articles.strip_distractions(df), articles.split_comments(df), articles.reader_view(df)):
        text = plan(out)
        assert "Exchange" not in text and "Python" not in text


def test_attributes(spark):
    tags = {
        "<a title=it's href=\"/q\">": "/q",
        "<a data-href='/x' HREF = '/y\"z'>": '/y"z',
        "<a href=/bare/>": "/bare/",
        "<a name=href>": None,
        "<a href>": None,
        '<a href="">': "",
        "<a title='<a href=no>' href=yes>": "yes",
    }
    df = spark.createDataFrame(list(tags.items()), "tag string, want string")
    got = {r.tag: r.got for r in df.withColumn("got", M.attribute(F.col("tag"), "href")).collect()}
    assert got == tags


def test_links_are_decoded_once_in_a_small_plan(spark):
    html = "<a title=it's href='/a?x=1&amp;y=2'>1</a><a title='<a href=\"/no\">' href=\"/b\">2</a><abbr href=/no>"
    df = spark.createDataFrame([(1, "https://s.org/d/", html)], "page_id bigint, url string, html string")
    got = sorted(r.url for r in links.extract_links(df).collect())
    assert got == ["https://s.org/a?x=1&y=2", "https://s.org/b"]
    assert len(plan(links.hot_links(links.extract_links(df), 3))) < 400_000
