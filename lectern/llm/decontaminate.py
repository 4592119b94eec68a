"""Benchmark passages in training texts, found with an FM-index per shard.

A task cuts its documents into shards of a bounded number of words (a longer text is
a shard of its own), indexes each and searches all windows of the benchmark in it
backwards; occurrences are located and merged into spans of words to remove. Words
that no item has separate runs, and a run shorter than every window holds none,
so only the other runs are indexed.

The benchmark is read in blocks of bounded size; each block is broadcast and searched
by one pass that hands its spans on to the next, so nothing is shuffled and no
task or broadcast grows with either table.

Defined results: a null or empty text or item has no words; an item shorter than the
window is one window; repeated rows are rows of their own; a null item id is listed as
'null'; columns of the documents pass through in one struct, so names cannot clash; empty
documents give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import BY_LETTER, text_bytes
from lectern.llm.fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20
FOUND = "n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The windows of one block of items, as rows of word numbers from 1, by length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [
                self.numbers.setdefault(w, len(self.numbers) + 1)
                for w in text.translate(BY_LETTER).split()
            ]
            size = min(window, len(words))
            for i in range(len(words) - size + 1) if words else ():
                owners.setdefault(tuple(words[i : i + size]), set()).add(item)
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for phrase in owners:
            by_size.setdefault(len(phrase), []).append(phrase)
        self.groups = [
            (size, np.array(phrases, dtype=np.int64), [sorted(owners[p]) for p in phrases])
            for size, phrases in sorted(by_size.items())
        ]
        self.shortest = min(by_size, default=0)


def phrase_blocks(benchmark: DataFrame, window: int, item: str, text: str) -> Iterator[Phrases]:
    """The benchmark in blocks of about BLOCK_BYTES of text, one partition at a time."""
    block: list[tuple[str, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    for row in rows.toLocalIterator():
        words = (row["text"] or "").encode()
        if block and size + len(words) > BLOCK_BYTES:
            yield Phrases(block, window)
            block, size = [], 0
        block.append(("null" if row["item"] is None else row["item"], words))
        size += len(words)
    yield Phrases(block, window)


def occurrences(words: list[bytes], phrases: Phrases) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, number of words, items) of every window found; documents end in b''."""
    ids = np.fromiter(map(phrases.numbers.get, words, repeat(0)), dtype=np.int64, count=len(words))
    edges = np.diff((ids != 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= phrases.shortest
    # Each run is kept with the separator after it.
    starts, sizes = starts[long], ends[long] - starts[long] + 1
    if not len(starts):
        return
    offsets = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    origin = offsets + np.arange(len(offsets))
    index = FMIndex(ids[origin])
    for size, group, owners in phrases.groups:
        low, high = index.ranges(group)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        first = np.repeat(low[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        places = origin[index.locate(first + np.arange(len(first)))]
        for phrase, place in zip(np.repeat(found, counts).tolist(), places.tolist(), strict=True):
            yield place, size, owners[phrase]


def search_shard(
    documents: list[list[bytes]], known: list[tuple[list, list]], phrases: Phrases
) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Merged spans and sorted items of each document; `known` has those of earlier blocks."""
    words: list[bytes] = []
    begins = np.zeros(len(documents) + 1, dtype=np.int64)
    for k, document in enumerate(documents):
        words += document
        words.append(b"")
        begins[k + 1] = len(words)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    items = [set(ids) for _, ids in known]
    found = list(occurrences(words, phrases))
    if found:
        at = np.array([place for place, _, _ in found])
        size = np.array([size for _, size, _ in found])
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        of = np.searchsorted(begins, at, side="right") - 1
        for k, (_, _, ids) in zip(of.tolist(), found, strict=True):
            items[k].update(ids)
    for k, (spans, _) in enumerate(known):
        for start, end in spans:
            cover[begins[k] + start] += 1
            cover[begins[k] + end] -= 1
    edges = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    merged: list[list[tuple[int, int]]] = [[] for _ in documents]
    of = np.searchsorted(begins, starts, side="right") - 1
    for k, start, end in zip(of.tolist(), starts.tolist(), ends.tolist(), strict=True):
        merged[k].append((start - int(begins[k]), end - int(begins[k])))
    return [(spans, sorted(ids)) for spans, ids in zip(merged, items, strict=True)]


def shard_search(shared, text: str):
    """For `mapInArrow`: batches of `row` (and the last block's findings) with this block's added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch in batches:
            row = batch.column("row")
            texts = text_bytes(row.field(text).filter(row.is_valid()) if row.null_count else row.field(text))
            earlier = (
                list(zip(
                    [[(s["start"], s["end"]) for s in spans] for spans in batch.column("spans").to_pylist()],
                    batch.column("items").to_pylist(),
                    strict=True,
                ))
                if "spans" in batch.schema.names
                else [([], [])] * len(texts)
            )
            n_words, out, shard, first, size = [], [], [], 0, 0
            for k, content in enumerate(texts):
                document = content.translate(BY_LETTER).split()
                n_words.append(len(document))
                if shard and size + len(document) > SHARD_WORDS:
                    out += search_shard(shard, earlier[first:k], phrases)
                    shard, first, size = [], k, 0
                shard.append(document)
                size += len(document)
            out += search_shard(shard, earlier[first:], phrases)
            spans = [[{"start": a, "end": b} for a, b in s] for s, _ in out]
            yield pa.RecordBatch.from_arrays(
                [
                    row,
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, SPANS),
                    pa.array([i for _, i in out], pa.list_(pa.string())),
                ],
                names=["row", "n_words", "spans", "items"],
            )

    return run


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """row (struct of all columns), n_words, merged spans of words, and items that occur."""
    schema = StructType(docs.select(F.struct("*").alias("row")).schema.fields)
    out_schema = f"row {schema['row'].dataType.simpleString()}, {FOUND}"
    found = docs.select(F.struct("*").alias("row"))
    for phrases in phrase_blocks(benchmark, window, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        found = found.mapInArrow(shard_search(shared, text), out_schema)
    return found


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns with the spans cut out of the texts.

    Words and the parts between them alternate, so a span goes together with what
    separates its words; texts without a span stay as they are.
    """
    word = F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = F.regexp_extract_all(F.col(f"row.{text}"), word, F.lit(0))
    gaps = F.split(F.col(f"row.{text}"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))
    between = lambda i: F.exists("spans", lambda s: (s["start"] < i) & (i < s["end"]))
    # Each word with the gap before it, bound once per row; the last gap has no word.
    parts = F.zip_with(gaps, words, lambda g, w: F.struct(g.alias("gap"), w.alias("word")))
    kept = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.concat(
                F.when(between(i), "").otherwise(p["gap"]),
                F.when(inside(i), "").otherwise(F.coalesce(p["word"], F.lit(""))),
            ),
        ),
        "",
    )
    cleaned = F.when(F.size("spans") > 0, kept).otherwise(F.col(f"row.{text}"))
    return found.withColumn("row", F.col("row").withField(text, cleaned)).select("row.*")
