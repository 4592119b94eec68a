"""The reader's tables, derived from the given ones as FIXTURES.md defines."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.text import first_line
from lectern.functions.urls import host_of
from lectern.schemas import EVENT_PROPS
from lectern.sources.ingest import ingest_snapshot
from lectern.sources.tables import load_tables

AS_OF = datetime(2024, 2, 1)
ACCOUNT = 7
PIVOT_ITEM = 140
DEFAULT_ICON = "data:image/gif;base64,default"
PREF_DEFAULTS = {"click": 0.0, "error": 0.0, "purchase": 10.0, "signup": 1.0, "view": 5.0}
REISSUED = 1_000_000_000_000

ACTIONS = {
    "view": "read",
    "signup": "unread",
    "purchase": "save",
    "error": "unsave",
    "click": "open",
}


def state_events(events: DataFrame) -> DataFrame:
    """The event log as read/unread/save/unsave/open actions; also works on a stream."""
    action = F.lit(None).cast("string")
    for event_type, name in ACTIONS.items():
        action = F.when(F.col("event_type") == event_type, name).otherwise(action)
    parsed = ingest_snapshot(
        events.select("event_id", "ts", "user_id", "event_type", "props"),
        "props",
        EVENT_PROPS,
    )
    return parsed.select(
        "event_id",
        F.col("user_id").alias("account_id"),
        F.col("k").alias("item_id"),
        action.alias("action"),
        "ts",
    )


def items(documents: DataFrame) -> DataFrame:
    """Documents as feed items; also works on a stream."""
    return documents.select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("feed_id"),
        "lang",
        first_line("text").alias("title"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"),
            F.col("doc_id").cast("string"),
        ).alias("url"),
        "text",
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00'"
            " + make_dt_interval(0, cast(doc_id % 720 as int))"
        ).alias("created_at"),
    )


@dataclass
class ReaderTables:
    spark: SparkSession
    directory: str

    @cached_property
    def source(self) -> dict[str, DataFrame]:
        return load_tables(self.spark, self.directory)

    @cached_property
    def items(self) -> DataFrame:
        return items(self.source["documents"])

    @cached_property
    def feeds(self) -> DataFrame:
        number = F.regexp_extract("source", "([0-9]+)", 1)
        return self.source["documents"].select("source").distinct().select(
            F.col("source").alias("feed_id"),
            number.cast("bigint").alias("feed_no"),
            F.concat(F.lit("Feed "), number).alias("title"),
            F.concat("source", F.lit(".example.com")).alias("host"),
        )

    @cached_property
    def groups(self) -> DataFrame:
        """Groups 0 to 5; group 5 has no feed."""
        return self.spark.range(6).select(
            F.col("id").alias("group_id"),
            F.concat(F.lit("Group "), F.col("id").cast("string")).alias("title"),
        )

    @cached_property
    def feed_groups(self) -> DataFrame:
        """Each feed in the group of its number, some in group 4 as well."""
        groups = F.when(
            F.col("feed_no") % 5 == 0, F.array(F.col("feed_no") % 4, F.lit(4).cast("bigint"))
        ).otherwise(F.array(F.col("feed_no") % 4))
        return self.feeds.select(F.explode(groups).alias("group_id"), "feed_id")

    @cached_property
    def state_events(self) -> DataFrame:
        return state_events(self.source["events"])

    @cached_property
    def prefs(self) -> DataFrame:
        return self.source["events"].select(
            F.col("user_id").alias("account_id"),
            F.col("event_type").alias("pref_key"),
            F.col("value").alias("pref_value"),
            "ts",
            "event_id",
        )

    @cached_property
    def account_feeds(self) -> DataFrame:
        """An account follows the feeds of the items whose links it opened."""
        opened = self.state_events.where(F.col("action") == "open").select("account_id", "item_id")
        return opened.join(self.items.select("item_id", "feed_id"), "item_id").select(
            "account_id", "feed_id"
        ).distinct()

    @cached_property
    def favicons(self) -> DataFrame:
        """Every third feed has no icon data."""
        return self.feeds.select(
            "feed_id",
            F.when(
                F.col("feed_no") % 3 != 0,
                F.concat(F.lit("data:image/gif;base64,"), F.col("feed_no").cast("string")),
            ).alias("data"),
        )

    @cached_property
    def item_overrides(self) -> DataFrame:
        """Every labelled document was edited by hand; the toxic ones lost their title as well."""
        return self.source["labels"].select(
            F.col("doc_id").alias("item_id"),
            F.when(F.col("toxic") == 1, "[removed]").alias("title"),
            F.concat(F.lit("edited "), F.col("doc_id").cast("string")).alias("text"),
        )

    @cached_property
    def feed_overrides(self) -> DataFrame:
        """Every seventh feed renamed and moved to group 3; null means not overridden."""
        mine = F.col("feed_no") % 7 == 0
        return self.feeds.select(
            "feed_id",
            F.when(
                mine, F.concat(F.lit("My feed "), F.col("feed_no").cast("string"))
            ).alias("title"),
            F.when(mine, F.lit(3).cast("bigint")).alias("group_id"),
        )

    @cached_property
    def local_copy(self) -> DataFrame:
        return self.items.select("item_id", "feed_id", "title", "text")

    @cached_property
    def remote_copy(self) -> DataFrame:
        """The same articles later: some re-issued under a new id, some with edited text."""
        return self.items.select(
            F.when(F.col("item_id") % 11 == 5, F.col("item_id") + REISSUED)
            .otherwise(F.col("item_id"))
            .alias("item_id"),
            "feed_id",
            "title",
            F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("!")))
            .otherwise(F.col("text"))
            .alias("text"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.source["pages"]

    @cached_property
    def page_items(self) -> DataFrame:
        """Pages as items; every fifth is an older row without a title."""
        return self.pages.select(
            F.col("page_id").alias("item_id"),
            host_of("url").alias("feed_id"),
            F.when(
                F.col("page_id") % 5 != 0,
                F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1),
            ).alias("title"),
            "url",
            "html",
        )

    @cached_property
    def pages_plus(self) -> DataFrame:
        """Pages with an image at the end of the article, some with a video, an advert that
        holds another one, markup in comments, and user comments of several parts."""
        number = F.col("page_id").cast("string")

        def where(every: int, rest: int, *parts) -> Column:
            return F.when(F.col("page_id") % every == rest, F.concat(*parts)).otherwise("")

        added = F.concat(
            F.lit('<img src="/i/'), (F.col("page_id") % 40).cast("string"), F.lit('.png">'),
            where(3, 0, F.lit('<iframe src="/v/'), number, F.lit('"></iframe>')),
            where(
                5, 0,
                F.lit("<aside title=it's class='wide AD'><aside>Buy <div>me</div></aside>"
                      '<div class="ad">twice</div>BUY NOW</aside>'),
            ),
            where(6, 1, F.lit("<!-- <script> --><p title=\"class='ad' >\">Still shown</p><!-- </div> -->")),
            where(
                4, 0,
                F.lit('<div class="user comments"><div>Comment on '), number,
                F.lit("</div><div>Answer to <div>"), number, F.lit("</div></div></div>"),
            ),
            F.lit("</article>"),
        )
        return self.pages.withColumn("html", F.replace("html", F.lit("</article>"), added))

    @cached_property
    def site_patterns(self) -> DataFrame:
        return self.spark.sql(
            "SELECT * FROM VALUES ('example.com', 'article'), ('example.net', 'article'),"
            " ('blog.tionsh.example.net', 'h1') AS t(host_suffix, body_pattern)"
        )

    @cached_property
    def alt_url_templates(self) -> DataFrame:
        """A full-text service for feeds of even number, none for the others."""
        return self.feeds.select(
            "feed_id",
            F.when(F.col("feed_no") % 2 == 0, "https://fulltext.example/extract?url=").alias(
                "prefix"
            ),
        )
