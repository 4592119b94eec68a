"""Declared schemas: nothing is inferred, neither in batch reads nor on streams."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, data_type) for name, data_type in fields.items()])


_ID, _TEXT, _TIME = LongType(), StringType(), TimestampNTZType()

DOCUMENTS = _struct(doc_id=_ID, text=_TEXT, lang=_TEXT, source=_TEXT, n_chars=LongType())
PAGES = _struct(page_id=_ID, url=_TEXT, html=_TEXT)
EVENTS = _struct(
    event_id=_ID, ts=_TIME, user_id=_ID, event_type=_TEXT, value=DoubleType(), props=_TEXT
)
LABELS = _struct(doc_id=_ID, quality=IntegerType(), toxic=IntegerType())

SOURCE_TABLES = {"documents": DOCUMENTS, "pages": PAGES, "events": EVENTS, "labels": LABELS}

EVENT_PROPS = _struct(k=_ID)
ITEM_PAYLOAD = _struct(
    feed=_struct(id=_TEXT, lang=_TEXT),
    items=ArrayType(_struct(id=_ID, title=_TEXT, tags=ArrayType(_TEXT))),
)
STORED_POSTINGS = _struct(
    term=_TEXT,
    item_id=_ID,
    tf=LongType(),
    positions=ArrayType(IntegerType()),
    item_length=LongType(),
    bucket=IntegerType(),
)
CORPUS_FIGURES = _struct(items=LongType(), mean_length=DoubleType(), buckets=IntegerType())
VERSIONS = _struct(version=LongType())
