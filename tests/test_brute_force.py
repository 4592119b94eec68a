"""Random small tables against plain Python written from the definitions."""

import random
import re
from datetime import timedelta

import pytest

from helpers import at, events, rows
from lectern.operators import counts, search, state, sync

ACTIONS = ["read", "unread", "save", "unsave", "open"]


def random_log(seed):
    rng = random.Random(seed)
    # Few minutes for many events, so that times tie.
    return [
        (n, rng.randrange(3), rng.randrange(4), rng.choice(ACTIONS),
         at(1) + timedelta(minutes=rng.randrange(400)))
        for n in rng.sample(range(1000), 300)
    ]


def flag_at(log, account, item, on, off, when=None):
    past = [e for e in log if e[1:3] == (account, item) and e[3] in (on, off)
            and (when is None or e[4] <= when)]
    return bool(past) and max(past, key=lambda e: (e[4], e[0]))[3] == on


@pytest.mark.parametrize("seed, bucket", [(1, "hour"), (2, "day"), (1, "minute")])
def test_state(spark, seed, bucket):
    log = random_log(seed)
    df = events(spark, *log)
    expected = {
        (a, i): (flag_at(log, a, i, "read", "unread"), flag_at(log, a, i, "save", "unsave"))
        for _, a, i, action, _ in log if action != "open"
    }
    assert {(r[0], r[1]): (r[2], r[3]) for r in state.current_state(df).collect()} == expected

    opened = df.where("action = 'open'").withColumnRenamed("event_id", "sync_id")
    got = {r.sync_id: r.is_read for r in state.state_as_of(df, opened, bucket=bucket).collect()}
    assert got == {
        e[0]: flag_at(log, e[1], e[2], "read", "unread", e[4]) for e in log if e[3] == "open"
    }

    flips = {}
    for e in sorted(log, key=lambda e: (e[4], e[0])):
        if e[3] in ("save", "unsave"):
            before, n = flips.get(e[1:3], (False, 0))
            now = e[3] == "save"
            flips[e[1:3]] = (now, n + (now != before))
    last = {}
    history = state.toggle_history(df, bucket=bucket).collect()
    for r in sorted(history, key=lambda r: (r.ts, r.event_id)):
        last[r.account_id, r.item_id] = (r.to_state, r.flips)
    assert last == flips


@pytest.mark.parametrize("seed", [3, 4])
def test_search(spark, seed):
    rng = random.Random(seed)
    texts = {
        n: rng.choice(["", " ", ", "]).join(
            rng.choice(["a", "b ", "c; ", " a b", "ab"]) for _ in range(rng.randrange(12))
        )
        for n in range(60)
    }
    items = spark.createDataFrame(list(texts.items()), "item_id bigint, text string")
    words = {n: re.findall(r"[^\W_]+", t.lower()) for n, t in texts.items()}

    def phrase_hits(phrase):
        hits = {n: sum(w[k:k + len(phrase)] == phrase for k in range(len(w)))
                for n, w in words.items()}
        return {n: h for n, h in hits.items() if h}

    for phrase in (["a", "b"], ["a", "a"], ["a", "b", "a"], ["c"]):
        postings = search.find_postings(items, phrase)
        found = search.search_phrase(postings, " ".join(phrase))
        assert dict(rows(found)) == phrase_hits(phrase)
    both = {n: w.count("a") + w.count("ab") for n, w in words.items() if {"a", "ab"} <= set(w)}
    assert dict(rows(search.search_all(search.build_index(items), ["a", "ab"]))) == both


@pytest.mark.parametrize("seed", [5, 6])
def test_sync_and_counts(spark, seed):
    rng = random.Random(seed)

    def copy():
        return {n: (rng.choice(["f", "g"]), rng.choice(["x", "y", None]))
                for n in range(40) if rng.random() < 0.7}

    def frame(rows_):
        return spark.createDataFrame(
            [(n, *v) for n, v in rows_.items()], "item_id bigint, feed_id string, text string"
        )

    here, there = copy(), copy()
    local, remote = frame(here), frame(there)
    diff = dict(rows(sync.sync_diff(local, remote, "item_id", ["feed_id", "text"])))
    assert diff == {
        n: "new" if n not in here else "removed" if n not in there
        else "same" if here[n] == there[n] else "changed"
        for n in {*here, *there}
    }
    merged = {r[0]: tuple(r[1:]) for r in sync.sync_upsert(local, remote, "item_id").collect()}
    assert merged == {**here, **there}

    flags = {n: (rng.random() < 0.5, rng.random() < 0.5) for n in range(0, 40, 2)}
    state_df = spark.createDataFrame(
        [(n, *f) for n, f in flags.items()], "item_id bigint, is_read boolean, is_saved boolean"
    )
    bridge = {("f", 0), ("f", 1), ("g", 1)}
    bridge_df = spark.createDataFrame(list(bridge), "feed_id string, group_id bigint")
    expected = {}
    for group in (0, 1, None):
        feeds = {f for f, g in bridge if group in (g, None)}
        held = [n for n, v in here.items() if v[0] in feeds]
        expected[group] = (
            len(held),
            sum(not flags.get(n, (False, False))[0] for n in held),
            sum(flags.get(n, (False, False))[1] for n in held),
        )
    got = {r[0]: tuple(r[1:]) for r in counts.group_counts(local, state_df, bridge_df).collect()}
    assert got == expected
