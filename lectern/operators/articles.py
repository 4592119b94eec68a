"""From raw pages to clean article text. Everything here works page by page, without a shuffle
of page content."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import markup as M, text as T
from lectern.functions.html_part import selected_text
from lectern.functions.urls import canonical_url, host_of
from lectern.plans.steps import stored


def _with_longest_suffix(df: DataFrame, host: str, patterns: DataFrame) -> DataFrame:
    """Left-join the pattern of the longest suffix of `host`.

    Patterns of one number of labels can match only the host's last so many
    labels, so each number in use is an equi-join.
    """
    # Of several patterns for one suffix, the last in text order.
    labelled = (
        patterns.groupBy(F.lower("host_suffix").alias("host_suffix"))
        .agg(F.max("body_pattern").alias("body_pattern"))
        .withColumn("_labels", F.size(F.split("host_suffix", r"\.")))
        # A host name has no more labels.
        .where(F.col("_labels") <= 127)
    )
    labelled = stored(labelled, "patterns")
    depths = [r[0] for r in labelled.select("_labels").distinct().collect()]
    depths.sort(reverse=True)
    for depth in depths:
        level = labelled.where(F.col("_labels") == depth).select(
            F.col("host_suffix").alias(f"_suffix{depth}"),
            F.col("body_pattern").alias(f"_pattern{depth}"),
        )
        df = df.join(
            level,
            F.substring_index(host, ".", -depth) == F.col(f"_suffix{depth}"),
            "left",
        )
    nothing = F.lit(None).cast("string")
    return df.withColumns(
        {
            "host_suffix": F.coalesce(*[f"_suffix{d}" for d in depths], nothing),
            "body_pattern": F.coalesce(
                # A suffix without a pattern still hides shorter ones.
                reduce(
                    lambda rest, d: F.when(
                        F.col(f"_suffix{d}").isNotNull(), F.col(f"_pattern{d}")
                    ).otherwise(rest),
                    reversed(depths),
                    nothing,
                )
            ),
        }
    ).drop(*[f"_{c}{d}" for c in ("suffix", "pattern") for d in depths])


def match_site_pattern(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pages with `host` and the most specific pattern for it, null if there is none.

    A pattern applies to its host and to hosts below it (`example.net` to
    `m.example.net`, not to `notexample.net`). The patterns are stored by suffix, so the
    planner knows that they are small and pages stay where they are.
    """
    return _with_longest_suffix(pages.withColumn("host", host_of("url")), "host", patterns)


def clean_article(pages: DataFrame) -> DataFrame:
    """Text of each page's `<article>`; empty where there is none."""
    return pages.select("page_id", T.article_text("html").alias("text"))


def clean_article_by_pattern(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Text of the part that each page's site pattern selects.

    Pages of sites without a pattern fall back to their dense text blocks. Patterns
    vary by row and elements nest, so this part runs over Arrow batches in Python.
    """
    matched = match_site_pattern(pages, patterns)
    return matched.select(
        "page_id",
        "host_suffix",
        F.when(F.col("body_pattern").isNull(), T.dense_blocks("html"))
        # Python sees the markup of pages that have a pattern only.
        .otherwise(
            selected_text(F.when(F.col("body_pattern").isNotNull(), F.col("html")), "body_pattern")
        )
        .alias("text"),
    )


def strip_distractions(pages: DataFrame, ad_classes: Sequence[str] = T.AD_CLASSES) -> DataFrame:
    """Pages without scripts, videos and adverts, and how many of each went.

    Adverts are elements of any tag that have one of the classes. An element ends at its own
    end tag, whatever is nested in it; of elements in one another of one kind the outermost
    counts. What stands in comments or in scripts is no element.
    """
    away = M.Wanted({"video": T.VIDEO_TAGS}, {"ad": ad_classes}, unseen=("script",))
    found = pages.select("page_id", "html", M.spans("html", away).alias("_found"))

    def number(kind: str) -> Column:
        return F.size(M.outermost(M.of_kind(F.col("_found"), kind))).cast("bigint")

    return found.select(
        "page_id",
        M.without("html", F.col("_found")).alias("html"),
        number("script").alias("scripts"),
        number("video").alias("videos"),
        number("ad").alias("ads"),
    )


def split_comments(pages: DataFrame, classes: Sequence[str] = T.COMMENT_CLASSES) -> DataFrame:
    """The markup without user comments, and the comments' text (null if there are none).

    A comment section is an element of any tag that has one of the classes, with all that is nested in it.
    """
    apart = M.Wanted(classes={"comments": classes}, unseen=T.NOT_SHOWN)
    found = pages.select("page_id", "html", M.spans("html", apart).alias("_found"))
    texts = F.transform(
        M.of_kind(M.outermost(F.col("_found")), "comments"),
        lambda s: T.plain_text(T.drop_unseen(M.inside(F.col("html"), s))),
    )
    return found.select(
        "page_id",
        M.without("html", F.col("_found"), spaced=T.NOT_SHOWN).alias("main"),
        F.nullif(F.array_join(texts, "\n"), F.lit("")).alias("comments"),
    )


def reader_view(pages: DataFrame) -> DataFrame:
    """Text without a site pattern: the long blocks that hold more text than markup."""
    return with_reader_view(pages).select("page_id", "text")


def with_reader_view(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", T.dense_blocks("html"))


def article_page(items: DataFrame, template: str) -> DataFrame:
    return with_article_page(items, template).select("item_id", "page")


def with_article_page(items: DataFrame, template: str) -> DataFrame:
    """Items with `page`: `template` with `{title}`, `{url}` and `{text}` filled in, HTML-escaped.

    The template is cut at its placeholders, so a value that looks like one is
    not filled again.
    """
    parts = []
    rest = template
    while rest:
        found = [(rest.find("{%s}" % c), c) for c in ("title", "url", "text")]
        at, name = min([f for f in found if f[0] >= 0], default=(len(rest), None))
        parts.append(F.lit(rest[:at]))
        rest = rest[at:]
        if name:
            parts.append(T.escape_html(F.coalesce(name, F.lit(""))))
            rest = rest[len(name) + 2:]
    return items.withColumn("page", F.concat(*parts))


def backfill_titles(items: DataFrame, html: str = "html") -> DataFrame:
    """Items with missing or blank titles filled: `<title>`, else `<h1>`, else the first text line."""
    def in_markup(pattern):
        return T.blank_to_null(T.plain_text(F.regexp_extract(T.drop_unseen(html), pattern, 1)))

    line = T.blank_to_null(T.first_line(T.dense_blocks(html)))
    # Kept as a conditional: the markup is searched only where the title is missing.
    given = T.blank_to_null(T.plain_text("title"))
    return items.withColumn(
        "title", F.coalesce(given, in_markup(T.TITLE), in_markup(T.HEADING), line)
    )


def extraction_report(clean: DataFrame, tiny: int = 200) -> DataFrame:
    """Of pages with `url` and extracted `text`, per site: pages, shares of empty and tiny extracts, mean and median length.

    Pages are counted per site and length first; the exact median then works on
    those counts, not on pages.
    """
    lengths = clean.select(host_of("url").alias("host"), F.length("text").cast("bigint").alias("chars"))
    return report_lengths(lengths, tiny)


def report_lengths(lengths: DataFrame, tiny: int = 200) -> DataFrame:
    """`extraction_report` over (host, chars) rows."""
    counted = (
        lengths.select("host", F.coalesce("chars", F.lit(0)).alias("chars"))
        .groupBy("host", "chars")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def share(condition):
        return F.round(
            F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n").cast("double"), 6
        )

    return counted.groupBy("host").agg(
        F.sum("n").alias("pages"),
        share(F.col("chars") == 0).alias("empty_share"),
        share(F.col("chars") < tiny).alias("tiny_share"),
        F.round(F.sum(F.col("n") * F.col("chars")) / F.sum("n").cast("double"), 6).alias(
            "mean_chars"
        ),
        F.percentile("chars", 0.5, F.col("n")).alias("median_chars"),
    )


def with_canonical_url(df: DataFrame) -> DataFrame:
    return df.withColumn("canonical_url", canonical_url("url"))
