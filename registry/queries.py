"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lectern import schemas
from lectern.functions.urls import canonical_url
from lectern.operators import (
    articles,
    counts,
    display,
    incremental,
    links,
    listings,
    overrides,
    search,
    state,
    sync,
)
from lectern.plans.reader_list import reader_list
from lectern.plans.steps import stored
from lectern.plans.views import build_views
from lectern.session import new_folder, prepare
from lectern.sources import ingest, reader_model as model, tables
from lectern.sources.change_table import ChangeTable
from lectern.sources.partition_sink import read_parts, write_changed
from lectern.sources.reader_model import ReaderTables
from lectern.streaming import feeds as streams, live, runner
from lectern.streaming.once import Taken, take_once

Query = Callable[[SparkSession, str], DataFrame]

TEMPLATE = (
    '<html><head><title>{title}</title></head><body><h1><a href="{url}">{title}</a></h1>'
    "<div>{text}</div></body></html>"
)
SEARCH_TERMS = ["the", "worthless", "with"]
PHRASE = "of the"
INDEX_BUCKETS = 16
MARK_TIME = datetime(2024, 2, 1)
LATE_ID = 1_000_000_000_000
LANDED_BATCHES = 3
LATE_DELAY = "2 days"
# Where indexes kept for a session lie, by session and table directory.
KEPT: dict[tuple[str, str], str] = {}


def _account(r: ReaderTables) -> DataFrame:
    return state.account_state(r.state_events, model.ACCOUNT)


# Sources, sinks, catalog


def q_load_tables(r: ReaderTables) -> DataFrame:
    """Every row of all four tables, their long columns as digests."""

    def shown(table: str, key: str, *values: str) -> DataFrame:
        def text(column: str) -> Column:
            kind = r.source[table].schema[column].dataType.typeName()
            if kind == "double":
                return F.format_string("%.12e", column)
            if kind == "timestamp_ntz":
                return F.unix_micros(F.col(column).cast("timestamp")).cast("string")
            return F.col(column).cast("string")

        parts = [F.coalesce(text(v), F.lit("")) for v in values]
        return r.source[table].select(
            F.lit(table).alias("table_name"),
            F.col(key).cast("bigint").alias("id"),
            F.md5(F.concat_ws("|", *parts)).alias("digest"),
        )

    return (
        shown("documents", "doc_id", "text", "lang", "source", "n_chars")
        .unionByName(shown("pages", "page_id", "url", "html"))
        .unionByName(shown("events", "event_id", "ts", "user_id", "event_type", "value", "props"))
        .unionByName(shown("labels", "doc_id", "quality", "toxic"))
    )


def q_ingest_snapshot(r: ReaderTables) -> DataFrame:
    return r.state_events.select("event_id", "account_id", "item_id", "action", "ts")


def _landed_payloads(r: ReaderTables) -> DataFrame:
    """Each document as a nested JSON payload; those in German arrive damaged."""
    payload = F.to_json(
        F.struct(
            F.struct(F.col("feed_id").alias("id"), "lang").alias("feed"),
            F.array(
                F.struct(
                    F.col("item_id").alias("id"),
                    "title",
                    F.array("lang", "feed_id").alias("tags"),
                )
            ).alias("items"),
        )
    )
    damaged = F.concat(F.lit("]"), payload)
    return r.items.select(
        F.col("item_id").alias("landing_id"),
        F.when(F.col("lang") == "de", damaged).otherwise(payload).alias("payload"),
    )


def q_ingest_nested(r: ReaderTables) -> DataFrame:
    parsed = ingest.ingest_snapshot(_landed_payloads(r), "payload", schemas.ITEM_PAYLOAD)
    return ingest.flatten_items(parsed)


def q_ingest_rejected(r: ReaderTables) -> DataFrame:
    bad = ingest.ingest_rejected(_landed_payloads(r), "payload", schemas.ITEM_PAYLOAD)
    return bad.select("landing_id")


def q_build_views(r: ReaderTables) -> DataFrame:
    build_views(
        r.spark,
        {
            "items": r.items,
            "feeds": r.feeds,
            "groups": r.groups,
            "feed_groups": r.feed_groups,
            "current_flags": state.current_state(r.state_events),
        },
    )
    return r.spark.sql("SELECT group_id, title, feeds, total FROM group_overview")


def q_feed_activity(r: ReaderTables) -> DataFrame:
    q_build_views(r)
    return r.spark.sql("SELECT account_id, feed_id, read, saved FROM feed_activity")


def q_write_local_copy(r: ReaderTables) -> DataFrame:
    """Two syncs, then the latest version read back."""
    path = new_folder(r.spark, "copy")
    tables.write_local_copy(r.local_copy, path, 1)
    first = tables.read_local_copy(r.spark, path, r.local_copy.schema)
    tables.write_local_copy(sync.sync_upsert(first, r.remote_copy, "item_id"), path, 2)
    latest = tables.read_local_copy(r.spark, path, r.local_copy.schema)
    return latest.select("item_id", "feed_id", "title", F.md5("text").alias("text_md5"))


def q_link_list(r: ReaderTables) -> DataFrame:
    return listings.link_list(r.items)


# Sync


def q_sync_diff(r: ReaderTables) -> DataFrame:
    return sync.sync_diff(r.local_copy, r.remote_copy, "item_id", ["feed_id", "title", "text"])


def q_sync_upsert(r: ReaderTables) -> DataFrame:
    merged = sync.sync_upsert(r.local_copy, r.remote_copy, "item_id")
    return merged.select("item_id", "feed_id", "title", F.md5("text").alias("text_md5"))


def _copy(r: ReaderTables) -> ChangeTable:
    """The local copy, stored."""
    copy = incremental.copy_table(
        r.spark, new_folder(r.spark, "changes"), r.local_copy.schema, "item_id", INDEX_BUCKETS
    )
    incremental.sync_incremental(copy, r.local_copy, incremental.changes(copy, r.local_copy))
    return copy


def q_sync_changes(r: ReaderTables) -> DataFrame:
    """What a sync with the later copy would write."""
    return incremental.changes(_copy(r), r.remote_copy)


def q_sync_incremental(r: ReaderTables) -> DataFrame:
    """A sync that writes changes only, some buckets compacted, and the copy read back."""
    copy = _copy(r)
    incremental.sync_incremental(copy, r.remote_copy, incremental.changes(copy, r.remote_copy))
    copy.compact(range(0, INDEX_BUCKETS, 3))
    return copy.read().select("item_id", "feed_id", "title", F.md5("text").alias("text_md5"))


def q_new_since(r: ReaderTables) -> DataFrame:
    return sync.new_since(r.remote_copy, r.local_copy, "item_id").select(
        "item_id", "feed_id", "title"
    )


def q_removed_items(r: ReaderTables) -> DataFrame:
    return sync.removed_items(
        r.local_copy.select("item_id", "feed_id", "title"), r.remote_copy, "item_id"
    )


def q_unchanged_rows(r: ReaderTables) -> DataFrame:
    return sync.unchanged_rows(r.local_copy, r.remote_copy).select("item_id", "feed_id", "title")


def q_changed_rows(r: ReaderTables) -> DataFrame:
    return sync.changed_rows(r.local_copy, r.remote_copy).select("item_id", "feed_id", "title")


def q_dedupe_items(r: ReaderTables) -> DataFrame:
    return sync.dedupe_items(r.items).select("item_id", "feed_id", "title", "copies")


def q_union_accounts(r: ReaderTables) -> DataFrame:
    """Two accounts, and the first one's items delivered once more."""
    one = r.local_copy.select(F.lit(1).cast("bigint").alias("account_id"), "item_id", "title")
    two = r.remote_copy.select(
        F.lit(2).cast("bigint").alias("account_id"), "item_id", "title", "feed_id"
    )
    again = one.withColumn("title", F.concat("title", F.lit(" (again)")))
    return sync.union_accounts([one, two, again], ["account_id", "item_id"])


# Hierarchy, listings, counts


def q_group_feeds(r: ReaderTables) -> DataFrame:
    return listings.group_feeds(r.groups, r.feed_groups, r.feeds)


def q_item_listing(r: ReaderTables) -> DataFrame:
    return listings.item_listing(r.items, 5)


def q_latest_items(r: ReaderTables) -> DataFrame:
    return listings.latest_items(r.items, 25)


def q_feed_counts(r: ReaderTables) -> DataFrame:
    return counts.feed_counts(r.items, _account(r))


def q_account_counts(r: ReaderTables) -> DataFrame:
    return counts.account_counts(r.items, state.current_state(r.state_events), r.account_feeds)


def _group_counts(r: ReaderTables) -> DataFrame:
    return counts.group_counts(r.items, _account(r), r.feed_groups)


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Null subtotal keys compare alike everywhere as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def q_group_counts(r: ReaderTables) -> DataFrame:
    return _as_text(_group_counts(r), "group_id")


def q_zero_count_groups(r: ReaderTables) -> DataFrame:
    return counts.zero_count_groups(r.groups, _group_counts(r))


def q_groups_with_unread(r: ReaderTables) -> DataFrame:
    unread = state.unread_items(r.items, _account(r))
    return counts.groups_with_unread(r.groups, r.feed_groups, unread)


def q_counts_rollup(r: ReaderTables) -> DataFrame:
    return _as_text(counts.counts_rollup(r.items, _account(r), r.feed_groups), "group_id")


def q_regroup_items(r: ReaderTables) -> DataFrame:
    by_day = r.items.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    chosen = counts.regroup_items(
        by_day, _account(r), ["feed_id"], ["lang"], ["day"], ["is_read"], ["lang", "is_read"]
    )
    return _as_text(chosen, "is_read")


def q_regroup_by_group(r: ReaderTables) -> DataFrame:
    return counts.regroup_items(
        r.items, _account(r), ["group_id", "lang"], feed_groups=r.feed_groups
    )


def q_counts_cube(r: ReaderTables) -> DataFrame:
    return counts.counts_cube(r.items, _account(r), ["feed_id", "lang"])


# State, preferences, overrides


def q_current_state(r: ReaderTables) -> DataFrame:
    return state.current_state(r.state_events)


def q_state_as_of(r: ReaderTables) -> DataFrame:
    """Whether an item was read at the times its links were opened."""
    opened = r.state_events.where(F.col("action") == "open").withColumnRenamed(
        "event_id", "sync_id"
    )
    return state.state_as_of(r.state_events, opened)


def q_unread_items(r: ReaderTables) -> DataFrame:
    return state.unread_items(r.items.select("item_id", "feed_id", "title"), _account(r))


def q_saved_items(r: ReaderTables) -> DataFrame:
    return state.saved_items(r.items.select("item_id", "feed_id", "title"), _account(r))


def q_mark_read(r: ReaderTables) -> DataFrame:
    narrow = r.items.select("item_id", "feed_id", "created_at")
    above, below, every = (
        state.mark_read(narrow, model.PIVOT_ITEM, mode).select(F.lit(mode).alias("mode"), "item_id")
        for mode in ("above", "below", "all")
    )
    return above.unionByName(below).unionByName(every)


def q_apply_marks(r: ReaderTables) -> DataFrame:
    marked = state.mark_read(
        r.items.select("item_id", "feed_id", "created_at"), model.PIVOT_ITEM, "above"
    )
    marks = state.marks_as_events(
        marked, model.ACCOUNT, "read", F.lit(MARK_TIME).cast("timestamp_ntz"), LATE_ID
    )
    return state.apply_marks(r.state_events, marks)


def q_toggle_history(r: ReaderTables) -> DataFrame:
    return state.toggle_history(r.state_events)


def q_preferences(r: ReaderTables) -> DataFrame:
    return state.preferences(r.prefs, model.PREF_DEFAULTS)


def q_apply_overrides(r: ReaderTables) -> DataFrame:
    changed = overrides.apply_overrides(r.items, r.item_overrides)
    return changed.select("item_id", "feed_id", "title", F.md5("text").alias("text_md5"))


def q_apply_view_overrides(r: ReaderTables) -> DataFrame:
    feeds = overrides.apply_view_overrides(r.feeds, r.feed_overrides)
    membership = overrides.apply_membership_overrides(r.feed_groups, r.feed_overrides)
    return listings.group_feeds(r.groups, membership, feeds)


# Article text and links


def q_match_site_pattern(r: ReaderTables) -> DataFrame:
    return articles.match_site_pattern(r.pages, r.site_patterns).select(
        "page_id", "host", "host_suffix", "body_pattern"
    )


def q_clean_article(r: ReaderTables) -> DataFrame:
    return articles.clean_article(r.pages)


def q_clean_article_by_pattern(r: ReaderTables) -> DataFrame:
    return articles.clean_article_by_pattern(r.pages, r.site_patterns)


def q_strip_distractions(r: ReaderTables) -> DataFrame:
    return articles.strip_distractions(r.pages_plus)


def q_split_comments(r: ReaderTables) -> DataFrame:
    return articles.split_comments(r.pages_plus)


def q_reader_view(r: ReaderTables) -> DataFrame:
    return articles.reader_view(r.pages)


def q_article_page(r: ReaderTables) -> DataFrame:
    return articles.article_page(r.items, TEMPLATE)


def q_article_pages_written(r: ReaderTables) -> DataFrame:
    """Pages written by feed, then again after one feed's titles changed, and read back."""
    path = new_folder(r.spark, "article-pages")

    def build(items: DataFrame) -> DataFrame:
        return articles.with_article_page(items, TEMPLATE).select("item_id", "page", "feed_id")

    later = F.when(F.col("feed_id") == "src3", F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    for items in (r.items, r.items.withColumn("title", later)):
        changed = write_changed(items, "feed_id", build, path, of=["item_id", "title", "url", "text"])
    pages = read_parts(r.spark, path, StructType.fromDDL("item_id bigint, page string, feed_id string"), "feed_id")
    return pages.join(changed, "feed_id", "left").select("item_id", F.md5("page").alias("page_md5"), "status")


def q_alternative_url(r: ReaderTables) -> DataFrame:
    return display.alternative_url(
        r.items.select("item_id", "feed_id", "url"), r.alt_url_templates
    )


def q_backfill_titles(r: ReaderTables) -> DataFrame:
    return articles.backfill_titles(r.page_items).select("item_id", "title")


def q_extraction_report(r: ReaderTables) -> DataFrame:
    """The dense-block reading of every page, per site."""
    return articles.extraction_report(articles.with_reader_view(r.pages))


def q_canonical_url(r: ReaderTables) -> DataFrame:
    return articles.with_canonical_url(r.pages.select("page_id", "url"))


def q_extract_links(r: ReaderTables) -> DataFrame:
    return links.extract_links(r.pages)


def q_hot_links(r: ReaderTables) -> DataFrame:
    return links.hot_links(links.extract_links(r.pages), 3)


def q_hot_links_estimate(r: ReaderTables) -> DataFrame:
    """The exact number beside the estimate's being near it: within three deviations."""
    found = links.extract_links(r.pages)
    estimate = links.hot_links_estimate(found, 0.02).withColumnRenamed("items", "estimate")
    exact = (
        found.select("item_id", F.expr("url"))
        .withColumn("url", canonical_url("url"))
        .distinct()
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("items"))
    )
    near = F.abs(F.col("estimate") - F.col("items")) <= F.greatest(0.06 * F.col("items"), F.lit(1.0))
    return exact.join(estimate, "url").select("url", "items", near.alias("near"))


def q_hot_links_merged(r: ReaderTables) -> DataFrame:
    """Pages land in three parts, one of them twice; the stored sketches are merged."""
    path = new_folder(r.spark, "sketches")
    found = links.extract_links(r.pages)
    for landing, part in enumerate([0, 1, 2, 1]):
        links.land_sketches(found.where(F.col("item_id") % 3 == part), path, landing)
    return links.merged_links(r.spark, path)


def q_image_manifest(r: ReaderTables) -> DataFrame:
    return links.image_manifest(r.pages_plus)


# Display data


def q_with_favicons(r: ReaderTables) -> DataFrame:
    return display.with_favicons(r.feeds, r.favicons, model.DEFAULT_ICON)


def q_friendly_dates(r: ReaderTables) -> DataFrame:
    """Of every state event and every item."""
    dated = r.state_events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "ts")
    created = r.items.select(
        F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("created_at").alias("ts")
    )
    return display.friendly_dates(dated.unionByName(created), "ts", datetime(2024, 1, 29, 18, 30))


def q_day_buckets(r: ReaderTables) -> DataFrame:
    return display.day_buckets(r.items, datetime(2024, 1, 29, 18, 30))


def q_reader_list(r: ReaderTables) -> DataFrame:
    feeds = overrides.apply_view_overrides(r.feeds, r.feed_overrides)
    membership = overrides.apply_membership_overrides(r.feed_groups, r.feed_overrides)
    titled = overrides.apply_overrides(
        r.items.select("item_id", "feed_id", "title", "url", "created_at"),
        r.item_overrides.select("item_id", "title"),
    )
    return reader_list(
        titled,
        feeds,
        membership,
        r.groups,
        r.favicons,
        r.state_events,
        model.ACCOUNT,
        model.AS_OF,
        model.DEFAULT_ICON,
    )


# Search and filter


def q_filter_items(r: ReaderTables) -> DataFrame:
    return listings.filter_items(
        r.items,
        text_has="The",
        group=4,
        feed_groups=r.feed_groups,
        since=datetime(2024, 1, 5),
        until=datetime(2024, 1, 25, 12),
        flags=_account(r),
        read=False,
    ).select("item_id", "feed_id", "title", "created_at")


def q_build_index(r: ReaderTables) -> DataFrame:
    return search.build_index(r.items).select(
        "term", "item_id", "tf", F.array_join("positions", ",").alias("positions"), "item_length"
    )


def _kept_index(r: ReaderTables) -> incremental.Index:
    """The index of all items, built by the first search of a session and kept for the others."""
    place = (r.spark.sparkContext.applicationId, r.directory)
    if place not in KEPT:
        index = incremental.Index(r.spark, new_folder(r.spark, "index"), INDEX_BUCKETS)
        index.update(r.items)
        KEPT[place] = index.path
    return incremental.Index(r.spark, KEPT[place], INDEX_BUCKETS)


def q_search_all(r: ReaderTables) -> DataFrame:
    return search.search_all(_kept_index(r).find(SEARCH_TERMS), SEARCH_TERMS)


def q_search_ranked(r: ReaderTables) -> DataFrame:
    index = _kept_index(r)
    return search.search_ranked(index.find(SEARCH_TERMS), index.figures(), SEARCH_TERMS, 20)


def q_search_phrase(r: ReaderTables) -> DataFrame:
    words = search.phrase_words(PHRASE)
    return search.search_phrase(_kept_index(r).find(words), PHRASE)


def q_search_unindexed(r: ReaderTables) -> DataFrame:
    """All the terms, straight from the articles, where no index is kept."""
    return search.search_all(search.find_postings(r.items, SEARCH_TERMS, every=True), SEARCH_TERMS)


def q_search_stored_index(r: ReaderTables) -> DataFrame:
    """The ranked search, from an index written as a table."""
    path = new_folder(r.spark, "index")
    search.write_index(search.build_index(r.items), path, INDEX_BUCKETS)
    postings = search.stored_postings(r.spark, path, SEARCH_TERMS)
    figures = search.read_figures(r.spark, path)
    return search.search_ranked(postings, figures, SEARCH_TERMS, 20)


def _index_in_step(r: ReaderTables) -> incremental.Index:
    """The index of the local copy, brought up to date with what changed in the later one."""
    index = incremental.Index(r.spark, new_folder(r.spark, "index"), INDEX_BUCKETS)
    index.update(r.local_copy)
    found = sync.sync_diff(r.local_copy, r.remote_copy, "item_id", ["feed_id", "title", "text"])
    coming = found.where("status in ('new', 'changed')").select("item_id")
    void = found.where("status in ('changed', 'removed')").select("item_id")
    index.update(r.remote_copy.join(coming, "item_id", "left_semi"), void)
    return index


def q_update_index(r: ReaderTables) -> DataFrame:
    return _index_in_step(r).postings.read().select(
        "term", "item_id", "tf", F.array_join("positions", ",").alias("positions"), "item_length"
    )


def q_search_updated_index(r: ReaderTables) -> DataFrame:
    """The ranked search from the index kept in step, half of its buckets compacted."""
    index = _index_in_step(r)
    index.compact(range(0, INDEX_BUCKETS, 2))
    return search.search_ranked(index.find(SEARCH_TERMS), index.figures(), SEARCH_TERMS, 20)


def q_search_filtered(r: ReaderTables) -> DataFrame:
    """All the terms, among unread items of one group only, from the index kept in step."""
    index = _index_in_step(r)
    chosen = listings.filter_items(
        r.items, group=4, feed_groups=r.feed_groups, flags=_account(r), read=False
    )
    return search.search_all(index.find_in(SEARCH_TERMS, chosen), SEARCH_TERMS)


# Streams


def _landed(r: ReaderTables, table: str) -> DataFrame:
    """The table as it lands in several batches of files, as many files as the table is read in."""
    schema = schemas.SOURCE_TABLES[table]
    path = new_folder(r.spark, f"landed-{table}")
    whole = r.spark.read.schema(schema).parquet(f"{r.directory}/{table}.parquet")
    files = -(-whole.rdd.getNumPartitions() // LANDED_BATCHES) or 1
    whole.repartition(LANDED_BATCHES * files).write.parquet(path)
    return streams.stream_items(r.spark, path, schema, files_per_batch=files)


def _event_stream(r: ReaderTables) -> DataFrame:
    return model.state_events(_landed(r, "events"))


def _sent_twice(r: ReaderTables) -> DataFrame:
    return _event_stream(r).unionByName(_event_stream(r))


def q_stream_items(r: ReaderTables) -> DataFrame:
    arriving = model.items(_landed(r, "documents"))
    taken = runner.run_append(arriving, new_folder(r.spark, "items"))[0]
    return taken.withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


def q_stream_dedupe(r: ReaderTables) -> DataFrame:
    return take_once(_sent_twice(r), new_folder(r.spark, "once")).rows


def q_stream_state(r: ReaderTables) -> DataFrame:
    flags = streams.stream_state(_event_stream(r))
    return runner.run_update(flags, new_folder(r.spark, "state"), state.KEYS)[0]


def q_stream_unread(r: ReaderTables) -> DataFrame:
    """The unread list from the live table, which takes up the log file by file."""
    folder = new_folder(r.spark, "live")
    flags = live.live_flags(r.spark, f"{folder}/flags", INDEX_BUCKETS)
    live.fold_flags(_event_stream(r), flags, f"{folder}/progress", most_runs=2)
    mine = live.account_flags(flags, model.ACCOUNT)
    return state.unread_items(r.items.select("item_id", "feed_id", "title"), mine)


def q_stream_counts(r: ReaderTables) -> DataFrame:
    """Windows over the stream of events taken up once; their state is the windows only."""
    folder = new_folder(r.spark, "counts")
    taken = take_once(_sent_twice(r), folder).rows
    once = streams.stream_items(r.spark, f"{folder}/rows", taken.schema)
    windows = streams.stream_windows(streams.with_event_time(once))
    return runner.run_update(windows, f"{folder}/windows", ["window_start"])[0]


def _taken_with_late(r: ReaderTables) -> Taken:
    """The whole log in several files, then the whole log again under new ids: most of it is too late by then."""
    folder = new_folder(r.spark, "late")
    landing = f"{folder}/landing"
    first = _event_stream(r)
    late = r.state_events.withColumn("event_id", F.col("event_id") + LATE_ID)
    r.spark.createDataFrame([], late.schema).write.parquet(landing)
    events = first.unionByName(streams.stream_items(r.spark, landing, late.schema))
    take_once(events, folder, LATE_DELAY)
    late.write.mode("append").parquet(landing)
    return take_once(events, folder, LATE_DELAY)


def q_stream_late(r: ReaderTables) -> DataFrame:
    taken = _taken_with_late(r)
    windows = streams.stream_windows(streams.with_event_time(taken.rows))
    return windows.withColumn("late", taken.late.select(F.count(F.lit(1))).scalar())


def q_stream_late_rows(r: ReaderTables) -> DataFrame:
    """The late events themselves."""
    return _taken_with_late(r).late


def q_stream_enriched(r: ReaderTables) -> DataFrame:
    # Stored, so that they are made once and not again in each batch, and of a known size.
    feeds, icons = stored(r.feeds, "feeds"), stored(r.favicons, "favicons")
    arriving = streams.stream_enriched(
        model.items(_landed(r, "documents")), feeds, icons, model.DEFAULT_ICON
    )
    return runner.run_append(arriving, new_folder(r.spark, "enriched"))[0]


def _over(build: Callable[[ReaderTables], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(ReaderTables(prepare(spark), sf_dir))

    return query


def all_queries() -> dict[str, Query]:
    return {
        name.removeprefix("q_"): _over(build)
        for name, build in globals().items()
        if name.startswith("q_")
    }
