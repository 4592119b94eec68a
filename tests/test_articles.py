import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from lectern.functions import html_part, text as T
from lectern.functions.urls import absolute_url, canonical_url, host_of
from lectern.operators import articles, links

LONG = "Long enough a paragraph of plain words to count as an article block, more than eighty."


def pages(spark, *html, url="https://www.site.org/dir/page?x=1"):
    return spark.createDataFrame(
        [(n, url, h) for n, h in enumerate(html)], "page_id bigint, url string, html string"
    )


def value(df, column):
    return [r[column] for r in df.orderBy(df.columns[0]).collect()]


def test_clean_article_cases(spark):
    df = pages(
        spark,
        '<script>var t="</p></article>";</script><article><p>One<p>two <b>three</article>after',
        "<article>&amp;lt; &lt;b&gt; a&nbsp;b</article>",
        "<article></article>",
        "<p>no article here</p>",
        "<ARTICLE class='x'>Upper<!-- <b>gone</b> --> case</ARTICLE>",
        "<article>cut &amp &lt off &apos &am</article>",
    )
    assert value(articles.clean_article(df), "text") == [
        "One two three", "&lt; <b> a b", "", "", "Upper case", "cut & < off &apos &am"
    ]


def test_nested_elements_are_balanced():
    html = "<article>outer <article>inner</article> tail</article> after <article>second</article>"
    assert html_part.part_text(html, "article") == "outer inner tail second"


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("div.story", "text here"),
        (".story", "text here"),
        ("#main", "text here and more"),
        ("div#main", "text here and more"),
        ("section", ""),
        ("not a selector!", ""),
    ],
)
def test_selectors(selector, expected):
    html = (
        '<div id="main"><div class="big story">text<br>here<script>if (a</div>b)</script></div>'
        " and more</div> outside"
    )
    assert html_part.part_text(html, selector) == expected


def test_part_text_of_nothing():
    assert html_part.part_text(None, "p") is None
    assert html_part.part_text("<p>x</p>", None) is None
    assert html_part.part_text("<p>never closed &amp;lt;", "p") == "never closed &lt;"


HOSTS = [
    (0, "https://example.net/a"),
    (1, "http://M.Example.NET:8080/a"),
    (2, "https://notexample.net/"),
    (3, "https://deep.blog.example.net/?q"),
    (4, "https://blog.example.net"),
    (5, "no url"),
    (6, "https://net/"),
]
PATTERNS = [("example.net", "article"), ("blog.example.net", "h1"), ("quiet.example.net", None)]


def test_the_most_specific_pattern_holds(spark):
    df = spark.createDataFrame(
        [*HOSTS, (7, "https://quiet.example.net/")], "page_id bigint, url string"
    )
    patterns = spark.createDataFrame(PATTERNS, "host_suffix string, body_pattern string")
    got = articles.match_site_pattern(df, patterns)
    assert rows(got.select("page_id", "host_suffix", "body_pattern")) == [
        (0, "example.net", "article"),
        (1, "example.net", "article"),
        (2, None, None),
        (3, "blog.example.net", "h1"),
        (4, "blog.example.net", "h1"),
        (5, None, None),
        (6, None, None),
        (7, "quiet.example.net", None),
    ]


def test_no_patterns_at_all(spark):
    df = spark.createDataFrame(HOSTS, "page_id bigint, url string")
    none = spark.createDataFrame([], "host_suffix string, body_pattern string")
    got = articles.match_site_pattern(df, none)
    assert got.where("body_pattern is not null or host_suffix is not null").count() == 0


def test_of_two_patterns_for_a_host_the_last_in_text_order_holds(spark):
    df = spark.createDataFrame([(0, "https://me:pw@WWW.example.com./x")], "page_id bigint, url string")
    twice = [("example.com", "b"), ("example.com", "a"), ("other.org", "c")]
    patterns = spark.createDataFrame(twice, "host_suffix string, body_pattern string")
    got = articles.match_site_pattern(df, patterns).select("host", "body_pattern")
    assert rows(got) == [("www.example.com", "b")]


def test_python_sees_only_pages_with_a_pattern(spark):
    patterns = spark.createDataFrame(PATTERNS, "host_suffix string, body_pattern string")
    text = plan(articles.clean_article_by_pattern(pages(spark, "<p>x</p>"), patterns))
    assert "CASE WHEN isnotnull(body_pattern" in text


def test_all_chosen_parts_and_implied_ends():
    from lectern.functions.html_part import part_text

    assert part_text('<p class="post">one</p>x<p class="post">two</p>', ".post") == "one two"
    assert part_text("<p class='b'>first<p>second<div>foot</div>", "p.b") == "first"


def test_references_are_decoded_once(spark):
    cases = {
        "AT&amp;amp;T": "AT&amp;T",
        "it&#8217;s &mdash; caf&eacute;": "it\u2019s \u2014 caf\u00e9",
        "&#391; &#x41; &#128; &#0; &lt &nosuch; &": "\u0187 A \u20ac \ufffd < &nosuch; &",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, expected string")
    assert df.where(T.decode_entities("t") != F.col("expected")).count() == 0


def test_links_in_any_quotes(spark):
    html = """<a href="/o'neil/story">1</a><a data-href="/track" href="/real">2</a><a href=/bare>3</a>"""
    site = "https://www.site.org"
    assert sorted(r.url for r in links.extract_links(pages(spark, html)).collect()) == [
        f"{site}/bare", f"{site}/o'neil/story", f"{site}/real"
    ]


def test_pages_without_pattern_use_dense_blocks(spark):
    df = pages(spark, f"<nav>menu</nav><p>{LONG}</p>")
    patterns = spark.createDataFrame(PATTERNS, "host_suffix string, body_pattern string")
    assert value(articles.clean_article_by_pattern(df, patterns), "text") == [LONG]


def test_distractions_are_counted(spark):
    df = pages(
        spark,
        '<script>1</script><div class="ad">buy</div><p>x</p><iframe src="v"></iframe>'
        '<video><source></video><embed src="e"><SCRIPT src="s"></SCRIPT>',
        "<p>clean</p>",
    )
    got = rows(articles.strip_distractions(df))
    assert got == [(0, "<p>x</p>", 2, 3, 1), (1, "<p>clean</p>", 0, 0, 0)]


def test_comments_are_split_off(spark):
    df = pages(
        spark,
        '<p>main</p><div class="comments"><b>first</b></div><div class="comments">second</div>',
        "<p>quiet</p>",
    )
    assert rows(articles.split_comments(df)) == [
        (0, "<p>main</p>", "first\nsecond"), (1, "<p>quiet</p>", None)
    ]


def test_reader_view_keeps_what_stands_between_dense_blocks(spark):
    df = pages(
        spark,
        f"<div class=\"ad\">{LONG}</div><p>{LONG}</p><p>short</p>"
        f"<li>{LONG} &amp; so on<li>menu",
    )
    assert value(articles.reader_view(df), "text") == [f"{LONG}\nshort\n{LONG} & so on"]


def test_article_page_fills_each_value_once_and_escaped(spark):
    items = spark.createDataFrame(
        [(1, 'A "b" <c>', "https://x/?a=1&b=2", "body with {title} & more"), (2, None, "u", "t")],
        "item_id bigint, title string, url string, text string",
    )
    got = value(articles.article_page(items, "<h1>{title}</h1>{text}<a href='{url}'>{title}</a>"), "page")
    assert got[0] == (
        "<h1>A &quot;b&quot; &lt;c&gt;</h1>body with {title} &amp; more"
        "<a href='https://x/?a=1&amp;b=2'>A &quot;b&quot; &lt;c&gt;</a>"
    )
    assert got[1] == "<h1></h1>t<a href='u'></a>"


def test_missing_titles_are_filled(spark):
    """Older saved rows came without a title."""
    html = [
        "<title>From &amp; title</title><h1>x</h1>",
        "<title> </title><h1>From <b>heading</b></h1>",
        f"<p>{LONG}</p>",
        "<title>unused</title>",
        "<p>nothing</p>",
    ]
    titles = [None, "", "   ", "Kept &amp; decoded", None]
    df = spark.createDataFrame(
        [(n, t, h) for n, (t, h) in enumerate(zip(titles, html))],
        "item_id bigint, title string, html string",
    )
    assert value(articles.backfill_titles(df), "title") == [
        "From & title", "From heading", LONG, "Kept & decoded", None
    ]


def test_extraction_report(spark):
    df = pages(spark, "a", "b", "c", "d")
    clean = spark.createDataFrame(
        [(0, ""), (1, "x" * 100), (2, "x" * 300), (3, None)], "page_id bigint, text string"
    )
    got = rows(articles.extraction_report(df.join(clean, "page_id")))
    assert got == [("www.site.org", 4, 0.5, 0.75, 100.0, 50.0)]


def test_urls(spark):
    base = "https://www.site.org/dir/page?x=1#f"
    cases = {
        "https://other.org/a": "https://other.org/a",
        "HTTP://other.org/a": "HTTP://other.org/a",
        "//cdn.org/i.png": "https://cdn.org/i.png",
        "/root": "https://www.site.org/root",
        "next": "https://www.site.org/dir/next",
        "?y=2&amp;z=3": "https://www.site.org/dir/page?y=2&z=3",
        "/r?a=1&copy=2": "https://www.site.org/r?a=1&copy=2",
        "#top": None,
        "": None,
        "mailto:a@b.c": None,
        "javascript:void(0)": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "ref string, expected string")
    for r in df.withColumn("got", absolute_url(F.lit(base), "ref")).collect():
        assert r.got == r.expected, r.ref
    bare = spark.createDataFrame([("https://host.org",)], "u string")
    assert bare.select(absolute_url("u", F.lit("a/b"))).first()[0] == "https://host.org/a/b"
    canonical = {
        "https://a.b/c/": "https://a.b/c",
        "https://a.b/c.html?x=1#f": "https://a.b/c",
        "https://a.b/c#top": "https://a.b/c",
        "https://a.b/c.html/": "https://a.b/c.html",
    }
    df = spark.createDataFrame([(k, v) for k, v in canonical.items()], "u string, expected string")
    assert df.where(canonical_url("u") != F.col("expected")).count() == 0
    assert bare.select(host_of("u")).first()[0] == "host.org"


def test_links_and_ranks(spark):
    a = '<a href="/x">1</a><a class="k" href=\'/x/\'>2</a><a href="#no">3</a><a href="/y">4</a>'
    df = pages(spark, a, '<a href="/x">1</a>', '<a href="/z">1</a><!-- <a href="/gone">-->')
    found = links.extract_links(df)
    assert found.count() == 5
    ranked = rows(links.hot_links(found, 2))
    site = "https://www.site.org"
    assert ranked == [(1, f"{site}/x", 2), (2, f"{site}/y", 1), (2, f"{site}/z", 1)]
    assert rows(links.hot_links(found, 1)) == [(1, f"{site}/x", 2)]
    assert rows(links.hot_links_estimate(found))[0] == (f"{site}/x", 2)


def test_image_manifest(spark):
    df = pages(spark, '<img src="/i.png"><img alt="" src="/i.png">', '<img src="j.png">')
    assert [r[:2] for r in rows(links.image_manifest(df))] == [
        ("https://www.site.org/dir/j.png", 1), ("https://www.site.org/i.png", 0)
    ]


def test_tokens_cover_scripts_and_digits(spark):
    df = spark.createDataFrame([("  Été 42, naïve—日本 x_y ",)], "t string")
    assert df.select(T.tokens("t")).first()[0] == ["été", "42", "naïve", "日本", "x", "y"]
