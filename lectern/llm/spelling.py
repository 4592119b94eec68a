"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word becomes the vector of how often it has each letter. One edit changes that vector by
an L1 distance of at most two: by one for a letter more or less, by up to two for another
letter. So words of one length are searched within two, words of lengths one apart within
one. Per length, a k-d tree fitted on a bounded sample of the words cuts the vectors into
cells; a word is filed in its cell and visits every cell whose box its ball meets. Within a
cell a second k-d tree over all of its words prunes by boxes again, and the letters of what
is left are compared in order. Cells that no split can part, words of the same letters,
are dealt out over several tasks.

Each word points to the most frequent near word, if that is much more frequent, as its form,
and the forms are followed to their root by doubling steps.

Defined results: null texts and texts without letters have no words; a null id counts as an
empty text in the checksum; repeated rows count as often as they occur; of equally frequent near
words the smallest in code-point order is the form; an empty table gives no rows; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.cells import meeting, met
from lectern.llm.common import stored, text_bytes
from lectern.llm.kd_tree import LEVELS, KdTree, bits_of

# Runs of a-z and of U+00C0 to U+00FF, in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LEAST_LETTERS = 6
LEAST_COUNT = 5
TYPO = 199
FORM_RATIO = 5

# Entries of a task's table of counts before it is passed on.
MOST_COUNTED = 300_000
# Letters beyond a-z share a few counters; sharing only lowers distances.
OTHERS = 6
DIMENSIONS = 26 + OTHERS
# Words per cell, and words that the cells are fitted on.
CELL = 65_536
SAMPLE_WORDS = 131_072
LEAST_SAMPLE = 16
LOCAL_LEAF = 96
# Letters compared at once.
LETTERS_AT_ONCE = 1 << 22


# Words and how often they occur


def words_of(key: bytes, text: bytes) -> Counter:
    """Words of one text, with the letter deleted that its checksum tells."""
    prefix = zlib.crc32(key + b":")
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.lower())).items():
        # Runs of fewer bytes have fewer letters too.
        if len(run) < LEAST_LETTERS:
            continue
        checksum = zlib.crc32(run, prefix)
        if checksum % TYPO == 0:
            word = run.decode()
            at = checksum % len(word)
            run = (word[:at] + word[at + 1 :]).encode()
        out[run] += n
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the partition with their counts, passed on whenever the table is full."""

    def passed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())],
            names=["word", "n"],
        )

    counts: Counter = Counter()
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text")), strict=True):
            counts.update(words_of(key.encode(), text))
            if len(counts) > MOST_COUNTED:
                yield passed_on(counts)
                counts = Counter()
    if counts:
        yield passed_on(counts)


def frequent_words(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """word, n and length of all words that are long and frequent enough."""
    keyed = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return (
        keyed.mapInArrow(count_words, "word string, n bigint")
        .where(F.length("word") >= LEAST_LETTERS)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
        .select("word", "n", F.length("word").alias("length"))
    )


# Letters as numbers


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points, words x length; all words have that length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(-1, length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each word has each letter, at most LEVELS, words x DIMENSIONS."""
    letter = codes.astype(np.int64) - ord("a")
    letter = np.where((letter >= 0) & (letter < 26), letter, 26 + codes % OTHERS)
    flat = letter + DIMENSIONS * np.arange(len(codes))[:, None]
    counts = np.bincount(flat.ravel(), minlength=DIMENSIONS * len(codes))
    return np.minimum(counts, LEVELS).astype(np.uint8).reshape(len(codes), DIMENSIONS)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows, those that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Of pairs of rows, those whose longer one is the shorter one with a letter more."""
    n = short.shape[1]
    ones = np.ones((len(short), 1), dtype=bool)
    before = np.hstack((ones, np.logical_and.accumulate(short == long[:, :n], axis=1)))
    after = np.hstack((np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1)[:, ::-1], ones))
    return (before & after).any(axis=1)


# Cells


def fit_cells(sample: list[str], words: int, cell: int) -> dict[int, KdTree]:
    """Per length a tree whose leaves hold about `cell` of all words, if the sample is like them."""
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    share = max(LEAST_SAMPLE, int(cell * len(sample) / max(1, words)))
    return {
        n: KdTree(letter_counts(letters(some, n)), share, tight=False) for n, some in by_length.items()
    }


def _of_one_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, letter counts) of the words of a batch."""
    lengths = batch.column("length").to_numpy()
    words = np.array(batch.column("word").to_pylist(), dtype=object)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        step = max(1, LETTERS_AT_ONCE // n)
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            yield n, part, letter_counts(letters(words[part].tolist(), n))


FILED = "length int, cell int, word string, n bigint"


def _filed(batch: pa.RecordBatch, rows: np.ndarray, length: int, cells: np.ndarray | int) -> pa.RecordBatch:
    kept = batch.select(["word", "n"]).take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), length, dtype=np.int32)),
            pa.array(np.broadcast_to(np.asarray(cells, dtype=np.int32), len(rows))),
            *kept.columns,
        ],
        names=["length", "cell", "word", "n"],
    )


def file_words(shared):
    """For `mapInArrow`: every word with its cell; lengths that were not sampled are one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, KdTree] = shared.value
        for batch in batches:
            for n, rows, counts in _of_one_length(batch):
                yield _filed(batch, rows, n, trees[n].cells(counts) if n in trees else 0)

    return run


def send_words(shared):
    """For `mapInArrow`: every word once per cell that may hold a word one edit away, no shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, KdTree] = shared.value
        for batch in batches:
            for n, rows, counts in _of_one_length(batch):
                bits = bits_of(counts)
                for other, distance in ((n, 2), (n + 1, 1)):
                    if other not in trees:
                        yield _filed(batch, rows, other, 0)
                        continue
                    for leaf, some in trees[other].reached(bits, distance):
                        yield _filed(batch, rows[some], other, leaf.cell)

    return run


NEAR = "word string, n bigint, near string, near_n bigint"


def compare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After `meeting`: words one edit apart, both ways."""

    def build(points: pa.Table):
        length = points.column("length")[0].as_py()
        codes = letters(points.column("word").to_pylist(), length)
        return points, length, codes, KdTree(letter_counts(codes), LOCAL_LEAF, tight=True)

    def search(built, probes: pa.Table) -> Iterator[pa.RecordBatch]:
        points, length, codes, tree = built
        words = probes.column("word").to_pylist()
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n, distance, same in ((length, 2, one_replaced), (length - 1, 1, one_inserted)):
            rows = np.flatnonzero(sizes == n)
            step = max(1, LETTERS_AT_ONCE // max(1, n))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                own = letters([words[i] for i in part], n)
                mine, theirs = [], []
                for i, j in tree.within(bits_of(letter_counts(own)), distance):
                    for b in range(0, len(i), step):
                        x, y = i[b : b + step], j[b : b + step]
                        found = same(own[x], codes[y])
                        mine.append(part[x[found]])
                        theirs.append(y[found])
                if mine:
                    yield from both_ways(probes, np.concatenate(mine), points, np.concatenate(theirs), n != length)

    yield from met(batches, ["length", "cell"], build, search)


def both_ways(
    probes: pa.Table, mine: np.ndarray, points: pa.Table, theirs: np.ndarray, mirrored: bool
) -> Iterator[pa.RecordBatch]:
    """Words of one length visit each other; of two lengths only the shorter one visits."""
    own = [probes.column(c).take(pa.array(mine)).combine_chunks() for c in ("word", "n")]
    near = [points.column(c).take(pa.array(theirs)).combine_chunks() for c in ("word", "n")]
    for columns in ([*own, *near], [*near, *own])[: 1 + mirrored]:
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])


# Forms and roots


def roots_of(forms: DataFrame) -> DataFrame:
    """word and root, where its forms end, of (word, form); doubled steps, so few rounds.

    A form is several times as frequent as its word, so there are no circles.
    """
    ends = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ends.join(further, "root", "left_semi").isEmpty():
            return ends
        ends = stored(
            ends.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")),
            "spelling-roots",
        )


def spelling_variants(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    cell: int = CELL,
    sample_words: int = SAMPLE_WORDS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every long and frequent word."""
    sc = docs.sparkSession.sparkContext
    words = stored(frequent_words(docs, id_column, text), "spelling-words")
    sample = words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample_words).toArrow()
    trees = fit_cells(sample.column("word").to_pylist(), words.count(), cell)
    # Bounded: leaves hold LEAST_SAMPLE sampled words at least, and carry no words here.
    shared = sc.broadcast(trees)
    points = words.mapInArrow(file_words(shared), FILED)
    probes = words.mapInArrow(send_words(shared), FILED)
    pairs = (
        meeting(points, probes, ["length", "cell"], "word", 2 * cell)
        .select("length", "cell", "part", "kind", "word", "n")
        .mapInArrow(compare_words, NEAR)
    )
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    near = stored(
        pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best)
        .select(
            "word",
            "n_near",
            F.when(-F.col("best.order") >= FORM_RATIO * F.col("n"), F.struct(
                F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n")
            )).alias("best"),
        )
        .select("word", "n_near", "best.form", "best.form_n"),
        "spelling-near",
    )
    roots = roots_of(near.where(F.col("form").isNotNull()))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            "form_n",
        )
    )
