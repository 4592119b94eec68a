"""Read and saved state derived from the event log, marks and preferences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.plans.ordering import event_order, last_known, time_bucket

KEYS = ["account_id", "item_id"]
ON = {"is_read": "read", "is_saved": "save"}
OFF = {"is_read": "unread", "is_saved": "unsave"}


def switch(flag: str) -> Column:
    """True or false where the action sets `flag`, null elsewhere."""
    return F.when(F.col("action") == ON[flag], True).when(F.col("action") == OFF[flag], False)


def flag_aggregates() -> list[Column]:
    """The latest value of each flag, false if never set; the same in batch and on streams."""
    order = event_order("ts", "event_id")
    return [
        F.coalesce(
            F.max_by(switch(flag), F.when(switch(flag).isNotNull(), order)), F.lit(False)
        ).alias(flag)
        for flag in ON
    ]


def current_state(events: DataFrame) -> DataFrame:
    """Flags in force now per account and item that has any state event.

    One hash aggregate with partial results before the shuffle, so an item that
    everyone opens costs one row per task.
    """
    relevant = events.where(F.col("action").isin([*ON.values(), *OFF.values()]))
    return relevant.groupBy(*KEYS).agg(*flag_aggregates())


def account_state(events: DataFrame, account: int) -> DataFrame:
    """Flags of one account, by item."""
    return current_state(events.where(F.col("account_id") == account)).drop("account_id")


def state_as_of(
    events: DataFrame,
    syncs: DataFrame,
    flag: str = "is_read",
    bucket: str = "day",
) -> DataFrame:
    """For each row of `syncs` (sync_id, account_id, item_id, ts): the flag in force at `ts`.

    An event at the very `ts` counts, and one without a time comes before all others.
    False before the first event.
    """
    value = switch(flag)
    states = events.where(value.isNotNull()).select(
        *KEYS, "ts", F.col("event_id").alias("_id"), value.alias("_value")
    )
    probes = syncs.select(
        *KEYS, "ts", F.col("sync_id").alias("_id"), F.lit(None).cast("boolean").alias("_value")
    )
    merged = last_known(
        states.unionByName(probes), KEYS, "ts", "_id", "_value", "_known", bucket
    )
    return merged.where(F.col("_value").isNull()).select(
        F.col("_id").alias("sync_id"),
        *KEYS,
        "ts",
        F.coalesce("_known", F.lit(False)).alias(flag),
    )


def unread_items(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items not read; `state` is that of one account."""
    return items.join(state.where("is_read").select("item_id"), "item_id", "left_anti").select(
        *items.columns
    )


def saved_items(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items saved now; `state` is that of one account."""
    return items.join(state.where("is_saved").select("item_id"), "item_id", "left_semi").select(
        *items.columns
    )


def mark_read(items: DataFrame, pivot: int, mode: str) -> DataFrame:
    """Items of the pivot's feed that marking `above`, `below` or `all` as read applies to.

    Above means earlier in the newest-first list; the pivot itself is part of
    `all` only. A filter against one broadcast row: nothing is sorted or shuffled.
    """
    at = (
        items.where(F.col("item_id") == pivot)
        .select(
            F.col("feed_id").alias("_feed"),
            F.col("created_at").alias("_created"),
            F.col("item_id").alias("_item"),
        )
        .limit(1)
    )
    mine = F.struct(F.col("created_at"), F.col("item_id"))
    its = F.struct(F.col("_created").alias("created_at"), F.col("_item").alias("item_id"))
    condition = F.col("feed_id") == F.col("_feed")
    if mode == "above":
        condition = condition & (mine > its)
    elif mode == "below":
        condition = condition & (mine < its)
    elif mode != "all":
        raise ValueError(f"mode must be above, below or all, not {mode!r}")
    return items.join(F.broadcast(at), condition, "left_semi")


def apply_marks(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Current state once `marks`, shaped like state events, have joined the log."""
    return current_state(events.unionByName(marks.select(*events.columns)))


def marks_as_events(
    items: DataFrame, account: int, action: str, ts: Column, first_id: int
) -> DataFrame:
    """One state event per item, with ids from `first_id` on that follow the item ids."""
    return items.select(
        (F.col("item_id") + F.lit(first_id)).alias("event_id"),
        F.lit(account).cast("bigint").alias("account_id"),
        "item_id",
        F.lit(action).alias("action"),
        ts.alias("ts"),
    )


def toggle_history(
    events: DataFrame, flag: str = "is_saved", bucket: str = "day"
) -> DataFrame:
    """Each switch of `flag` with the state before it and the number of real flips so far.

    Before the first switch an item is unread and unsaved. Items are scanned per
    time bucket, so that it is spread over tasks; per bucket only its first and last
    state and its flips are carried on. An event without account, item or time
    switches nothing.
    """
    switches = events.select("event_id", *KEYS, "ts", switch(flag).alias("to_state"))
    # Spelt out as the join below infers it, so that both its sides share one shuffle.
    for name in (*KEYS, "ts", "to_state"):
        switches = switches.where(F.col(name).isNotNull())

    cut = switches.withColumn("_bucket", time_bucket("ts", bucket))
    scanned = _scan_flips(cut, [*KEYS, "_bucket"])
    scanned = scanned.join(_carry_flips(scanned), [*KEYS, "_bucket"], "left")
    # What the first switch of a scan does depends on the state before it.
    entry = F.coalesce("_entry", F.lit(False))
    flips = (
        F.col("_flips")
        + F.coalesce("_earlier", F.lit(0))
        + (F.col("_opening") != entry).cast("bigint")
    )
    return scanned.select(
        "event_id",
        *KEYS,
        "ts",
        F.coalesce("_before", entry).alias("from_state"),
        "to_state",
        flips.alias("flips"),
    )


def _scan_flips(switches: DataFrame, partition: list[str]) -> DataFrame:
    """The state before each switch, the first state, and the flips so far, within partitions."""
    inside = Window.partitionBy(*partition).orderBy("ts", "event_id")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flip = F.coalesce(F.col("_before") != F.col("to_state"), F.lit(False)).cast("bigint")
    return (
        switches.withColumn("_before", F.lag("to_state").over(inside))
        .withColumn("_opening", F.first("to_state").over(running))
        .withColumn("_flips", F.sum(flip).over(running))
    )


def _carry_flips(scanned: DataFrame) -> DataFrame:
    """Per bucket of a hot item: the state it starts in, and the flips before it."""
    order = F.struct("ts", "event_id")
    summary = (
        scanned.where(F.col("_bucket").isNotNull())
        .groupBy(*KEYS, "_bucket")
        .agg(
            F.first("_opening").alias("_first"),
            F.max_by("to_state", order).alias("_last"),
            F.max("_flips").alias("_inner"),
        )
    )
    by_bucket = Window.partitionBy(*KEYS).orderBy("_bucket")
    entry = F.coalesce(F.lag("_last").over(by_bucket), F.lit(False))
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    entered = summary.withColumn("_entry", entry).withColumn(
        "_all", F.col("_inner") + (F.col("_entry") != F.col("_first")).cast("bigint")
    )
    return entered.select(*KEYS, "_bucket", "_entry", F.sum("_all").over(earlier).alias("_earlier"))


def preferences(prefs: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """One row per account with a column per known key: the last value written, else the default.

    The keys are known, so the pivot is a conditional aggregate: one shuffle by account.
    """
    order = event_order("ts", "event_id")
    values = [
        F.coalesce(
            F.max_by(
                F.when(F.col("pref_key") == key, F.col("pref_value")),
                F.when((F.col("pref_key") == key) & F.col("pref_value").isNotNull(), order),
            ),
            F.lit(default),
        ).alias(key)
        for key, default in defaults.items()
    ]
    return prefs.groupBy("account_id").agg(*values)
