"""Small tables for hand-made cases."""

from datetime import datetime

STATE = "event_id bigint, account_id bigint, item_id bigint, action string, ts timestamp_ntz"


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), STATE)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]
